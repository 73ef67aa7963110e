"""Rolling error means on a stream of scored points, equal to the batch series whatever the order of arrival.

Each entity keeps a ring in keyed state: its points of the last ``lateness`` days, by its own latest date, and the
``window - 1`` points before them. A point that falls into the ring, new or a correction, changes the windows that end at
it and at the next ``window - 1`` points; exactly these are emitted again. A point from before the ring is marked late:
its windows are computed from the table of all points, which the sink keeps, so no point is dropped. State is bounded by
the points of ``lateness`` days plus a window per entity. No watermark is used, as that would drop late rows unseen and
let one entity that is ahead close the books of all others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsspark.operators.history import WINDOW_BOUNDS, error_points, rolling_error_series
from tsspark.sources.keyed import KeyedTable, newest

STATE = "days array<int>, abs_errors array<double>, apes array<double>, cut boolean"
#: A scored point, or a window that ends at the date: its errors, or their means.
POINT, WINDOW = "point", "window"


def _mean(values: list[float], digits: int, scale: int = 1) -> float:
    """As the batch form rounds: an average of decimals with 12 digits, then ``digits``."""
    total = sum((Decimal(repr(v)) for v in values), Decimal(0)) / len(values)
    total = total.quantize(Decimal(1).scaleb(-12), ROUND_HALF_UP) * scale
    return float(total.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


class Ring:
    """The points of one entity in date order; ``cut`` tells that older ones were let go."""

    def __init__(self, window: int, lateness: int, days: list[int], points: list[tuple[float, float]], cut: bool):
        self.window, self.lateness, self.days, self.points, self.cut = window, lateness, days, points, cut

    def late(self, day: int) -> bool:
        """Whether fewer than ``window - 1`` points before that day are still here, though there were more."""
        return self.cut and day <= self.days[self.window - 2]

    def put(self, day: int, point: tuple[float, float]) -> None:
        at = bisect_left(self.days, day)
        if at < len(self.days) and self.days[at] == day:
            self.points[at] = point
        elif at or not self.cut:  # before the ring there is nothing to keep it with
            self.days.insert(at, day)
            self.points.insert(at, point)

    def touched(self, changed: list[int]) -> list[int]:
        """Places at which windows end that hold one of the changed days, and are whole."""
        places: set[int] = set()
        for day in changed:
            at = bisect_left(self.days, day)
            if at < len(self.days) and self.days[at] == day:
                places.update(range(max(at, self.window - 1), min(at + self.window, len(self.days))))
        return sorted(places)

    def means(self, place: int) -> tuple[float, float]:
        own = self.points[place - self.window + 1 : place + 1]
        return _mean([a for a, _ in own], 6), _mean([p for _, p in own], 4, 100)

    def shrink(self) -> None:
        """Let go of what is neither within ``lateness`` of the latest day nor among the points before that."""
        keep = max(0, bisect_left(self.days, self.days[-1] - self.lateness + 1) - (self.window - 1))
        if keep:
            self.days, self.points, self.cut = self.days[keep:], self.points[keep:], True


def rolling_stream(points: DataFrame, window: int, lateness_days: int, entity: str = "entity", date: str = "date") -> DataFrame:
    """(entity, date, kind, first, second, late): every point as it came, and every window it changed.

    ``points``: a stream of ``error_points``. Of several points for one key in a micro-batch the greatest ``age`` counts,
    a later micro-batch replaces an earlier one.
    """
    least, most = WINDOW_BOUNDS
    if not least <= window <= most or lateness_days < 0:
        raise ValueError(f"A window of {window} points is outside {least} to {most}, or lateness is negative.")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            days, abs_errors, apes, cut = state.get
            ring = Ring(window, lateness_days, list(days), list(zip(abs_errors, apes, strict=True)), cut)
        else:
            ring = Ring(window, lateness_days, [], [], False)
        new: dict[int, tuple[float, float, float]] = {}
        for frame in frames:
            for day, age, a, p in zip(frame["day"], frame["age"], frame["abs_error"], frame["ape"], strict=True):
                new[int(day)] = max(new.get(int(day), (float("-inf"), 0.0, 0.0)), (float(age), float(a), float(p)))
        rows = []
        for day, (_, a, p) in sorted(new.items()):
            rows.append((key[0], day, POINT, a, p, ring.late(day)))
        for day, (_, a, p) in new.items():
            ring.put(day, (a, p))
        rows += [(key[0], ring.days[k], WINDOW, *ring.means(k), False) for k in ring.touched(list(new))]
        ring.shrink()
        state.update((ring.days, [a for a, _ in ring.points], [p for _, p in ring.points], ring.cut))
        yield pd.DataFrame(rows, columns=["entity", "day", "kind", "first", "second", "late"])

    kind = points.schema[entity].dataType.simpleString()
    narrow = points.select(F.col(entity).alias("entity"), F.unix_date(F.col(date).cast("date")).alias("day"), "abs_error", "ape", "age")
    out = f"entity {kind}, day int, kind string, first double, second double, late boolean"
    made = narrow.groupBy("entity").applyInPandasWithState(update, out, STATE, "update", GroupStateTimeout.NoTimeout)
    return made.select(F.col("entity").alias(entity), F.date_from_unix_date("day").alias(date), "kind", "first", "second", "late")


def rolling_table(spark: SparkSession, path: str, entity: str = "entity", date: str = "date", entity_type: T.DataType = T.StringType(), **layout: int) -> KeyedTable:
    """(entity, date, mae, mape): the windows, by the date they end at."""
    schema = T.StructType([T.StructField(entity, entity_type), T.StructField(date, T.DateType()), T.StructField("mae", T.DoubleType()), T.StructField("mape", T.DoubleType())])
    return KeyedTable(spark, path, schema, (entity, date), date, **layout)


def rolling_sink(
    pairs: DataFrame, window: int, lateness_days: int, errors: KeyedTable, windows: KeyedTable, checkpoint: str, order: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Arriving (entity, date, y_true, y_pred) rows into the table of errors and the table of windows.

    The points of a micro-batch are stored first; entities with a late point then have their series computed from the
    stored points. A micro-batch that is repeated after a stop is recognised by each table on its own.
    """
    date = errors.date
    entity = next(k for k in errors.keys if k != date)
    spark = pairs.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            points = batch.where(F.col("kind") == POINT)
            scored = points.select(entity, date, F.col("first").alias("abs_error"), F.col("second").alias("ape"), F.lit(0.0).alias("age"))
            errors.upsert(scored, newest(errors.keys, ()), (checkpoint, number))
            made = batch.where(F.col("kind") == WINDOW).select(entity, date, F.col("first").alias("mae"), F.col("second").alias("mape"))
            behind = points.where("late").select(entity).distinct()
            history = errors.read().join(behind, entity, "left_semi")
            again = rolling_error_series(history, window, entity, date).select(*made.columns)
            whole = made.join(behind, entity, "left_anti").unionByName(again)
            windows.upsert(whole, newest(windows.keys, ()), (checkpoint, number))
        finally:
            batch.unpersist()

    scored = rolling_stream(error_points(pairs, entity, date, order), window, lateness_days, entity, date)
    writer = scored.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
