"""Arriving sales rows in one pass to two tables: rows on time to the panel, late and repeated ones to the side.

Each entity keeps in keyed state its latest day and the days it has seen of the last ``lateness_days``, so state is bounded
whatever the length of the history. A row is late if its day is further back than that from the latest day of earlier
micro-batches, and repeated if its day was seen. Rows on time go to the keyed table, where they touch the newest buckets
only. The others wait in a side table, a folder per micro-batch, until ``merge_side`` brings them into the panel by key, all
buckets at once, and removes the folders. No row is dropped: both tables together hold every row that has a date.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsspark.sources.commits import Folder
from tsspark.sources.keyed import KeyedTable, newest

STATE = "latest int, seen array<int>"
ON_TIME, LATE, REPEATED = "on time", "late", "repeated"


def marked(rows: DataFrame, lateness_days: int, entity: str = "entity", date: str = "date") -> DataFrame:
    """Every row of the stream with its ``fate``; of equal days in one micro-batch the first row by value is on time."""
    names = rows.columns
    at = [f"_c{k}" for k in range(len(names))]
    day, key = at[names.index(date)], at[names.index(entity)]

    def update(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, seen = state.get if state.exists else (None, [])
        frame = pd.concat(list(frames), ignore_index=True)
        frame = frame.sort_values([c for c in frame.columns if c != key], kind="stable", na_position="last", ignore_index=True)
        known, fates = set(seen), []
        for number in frame["_day"].astype(int):
            if latest is not None and number <= latest - lateness_days:
                fates.append(LATE)
            else:
                fates.append(REPEATED if number in known else ON_TIME)
                known.add(number)
        newest_day = max(int(frame["_day"].max()), latest if latest is not None else -(1 << 31))
        state.update((newest_day, sorted(d for d in known if d > newest_day - lateness_days)))
        yield frame.drop(columns="_day").assign(fate=fates)

    coded = rows.where(F.col(date).isNotNull()).select(*[F.col(n).alias(a) for n, a in zip(names, at, strict=True)])
    coded = coded.withColumn("_day", F.unix_date(F.col(day).cast("date")))
    out = T.StructType([T.StructField(a, rows.schema[n].dataType) for n, a in zip(names, at, strict=True)]).add("fate", T.StringType())
    made = coded.groupBy(key).applyInPandasWithState(update, out, STATE, "update", GroupStateTimeout.NoTimeout)
    return made.select(*[F.col(a).alias(n) for n, a in zip(names, at, strict=True)], "fate")


def late_sales_sink(rows: DataFrame, lateness_days: int, panel: KeyedTable, side: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rows on time into ``panel``, the others below ``side``; a repeated micro-batch overwrites what it wrote."""
    date = panel.date
    entity = next(k for k in panel.keys if k != date)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            on_time = F.col("fate") == ON_TIME
            panel.upsert(batch.where(on_time).drop("fate"), newest(panel.keys, ()), (checkpoint, number))
            batch.where(~on_time).write.mode("overwrite").parquet(f"{side}/batch={number}")
        finally:
            batch.unpersist()

    writer = marked(rows, lateness_days, entity, date).writeStream.foreachBatch(write)
    writer = writer.outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def side_rows(spark: SparkSession, side: str, schema: T.StructType) -> DataFrame:
    """What waits in the side table: the rows, their ``fate`` and ``batch``."""
    full = T.StructType([*schema.fields, T.StructField("fate", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(side)


def merge_side(spark: SparkSession, panel: KeyedTable, side: str) -> int:
    """Bring the waiting rows into the panel, those of later micro-batches over earlier ones; returns how many batches.

    Merged folders are removed afterwards. If the job stops in between, the next call finds their numbers in the panel's
    version record and only removes them.
    """
    folder, stream = Folder(spark, side), f"side of {side}"
    waiting = sorted(int(n.removeprefix("batch=")) for n in folder.names() if n.startswith("batch="))
    if not waiting:
        return 0
    done = panel.last_batch(stream)
    rows = side_rows(spark, side, panel.schema).where(F.col("batch") <= waiting[-1])
    rows = rows.where(F.col("batch") > done) if done is not None else rows
    row = F.max_by(F.struct(*panel.schema.names), F.struct("batch", *panel.schema.names)).alias("row")
    panel.upsert(rows.groupBy(*panel.keys).agg(row).select("row.*"), newest(panel.keys, ()), (stream, waiting[-1]))
    for number in waiting:
        folder.remove(f"batch={number}")
    return len(waiting)
