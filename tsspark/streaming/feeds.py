"""Arriving sales files, and arriving forecast scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tsspark.operators.history import append_errors, error_points
from tsspark.sources.keyed import KeyedTable, newest


def sales_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    date: str = "date",
    entity: str = "entity",
    lateness: str = "7 days",
    **options: str,
) -> DataFrame:
    """Rows of CSV files as they arrive, each (entity, date) once.

    State is kept only for days younger than the watermark, so it does not grow with the history. Rows later than that
    are dropped; ``sales_sink`` keeps them.
    """
    raw = spark.readStream.schema(schema).options(header=True, **options).csv(folder)
    timed = raw.withColumn("event_time", F.col(date).cast("timestamp")).where(F.col("event_time").isNotNull())
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([entity, "event_time"]).drop("event_time")


def sales_sink(
    spark: SparkSession, folder: str, schema: T.StructType, path: str, checkpoint: str, date: str = "date", entity: str = "entity", available_now: bool = True, **options: str
) -> StreamingQuery:
    """Arriving CSV rows into the table at ``path``, however late; ``current_sales`` reads each (entity, date) once.

    No state is kept: a micro-batch is made unique by itself and written to a folder of its own number, which it
    overwrites when it is repeated. The folders add up; ``sales_table_sink`` keeps their number bounded.
    """
    raw = spark.readStream.schema(schema).options(header=True, **options).csv(folder)

    def write(batch: DataFrame, number: int) -> None:
        dated = batch.where(F.col(date).cast("timestamp").isNotNull())
        dated.dropDuplicates([entity, date]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_sales(spark: SparkSession, path: str, schema: T.StructType, entity: str = "entity", date: str = "date") -> DataFrame:
    """One row per (entity, date): that of the latest batch, so a late correction wins."""
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    row = F.max_by(F.struct(*schema.names), "batch").alias("row")
    return written.groupBy(entity, date).agg(row).select("row.*")


def errors_sink(
    pairs: DataFrame, path: str, checkpoint: str, entity: str = "entity", date: str = "date", available_now: bool = True
) -> StreamingQuery:
    """Score arriving (entity, date, y_true, y_pred) rows into the error table at ``path``.

    A micro-batch is written to a folder of its own number and overwrites it when it is repeated, so a
    restart neither loses nor doubles points. ``current_errors`` reads the newest point per key. The folders add up;
    ``errors_table_sink`` keeps their number bounded.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_errors(None, batch, entity, date).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_errors(spark: SparkSession, path: str, entity: str = "entity", date: str = "date") -> DataFrame:
    """One point per (entity, date): that of the latest batch."""
    written = spark.read.parquet(path)
    point = F.max_by(F.struct("abs_error", "ape"), "batch").alias("point")
    return written.groupBy(entity, date).agg(point).select(entity, date, "point.abs_error", "point.ape")


#: Columns of the error table.
ERRORS = ("abs_error", "ape", "age")


def errors_table(
    spark: SparkSession, path: str, entity: str = "entity", date: str = "date", entity_type: T.DataType = T.StringType(), date_type: T.DataType = T.DateType(), **layout: int
) -> KeyedTable:
    """The keyed table of forecast errors at ``path``; ``layout`` as for ``KeyedTable``."""
    schema = T.StructType([T.StructField(entity, entity_type), T.StructField(date, date_type), *[T.StructField(c, T.DoubleType()) for c in ERRORS]])
    return KeyedTable(spark, path, schema, (entity, date), date, **layout)


def upsert_errors(table: KeyedTable, pairs: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
    """Score (entity, date, y_true, y_pred) rows into the table.

    Of several points for one key the one with the greatest ``order`` wins, also against points already there; without
    ``order`` a later call wins.
    """
    entity = next(k for k in table.keys if k != table.date)
    return table.upsert(error_points(pairs, entity, table.date, order), newest(table.keys, ("age",) if order else ()), batch)


def errors_table_sink(
    pairs: DataFrame, table: KeyedTable, checkpoint: str, order: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Arriving pairs into a keyed table; a repeated micro-batch is recognised, the number of files stays bounded."""
    writer = pairs.writeStream.foreachBatch(lambda batch, number: upsert_errors(table, batch, order, (checkpoint, number)) and None)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sales_table_sink(
    spark: SparkSession, folder: str, table: KeyedTable, checkpoint: str, order: str | None = None, available_now: bool = True, **options: str
) -> StreamingQuery:
    """Arriving CSV rows into a keyed table, however late; the row with the greatest ``order``, or the later batch, wins."""
    raw = spark.readStream.schema(table.schema).options(header=True, **options).csv(folder)
    merge = newest(table.keys, (order,) if order else ())

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch.where(F.col(table.date).isNotNull()), merge, (checkpoint, number))

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
