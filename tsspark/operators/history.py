"""The table of past forecast errors: upsert, cap, rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.functions import errors
from tsspark.functions.rounding import round_stored
from tsspark.functions.missing import is_finite

# Bounds of the rolling window unless the caller sets others.
WINDOW_BOUNDS = (2, 90)

#: Positions per block of the series across entities; a block is the largest window group there.
BLOCK_POINTS = 100_000


def error_points(pairs: DataFrame, entity: str = "entity", date: str = "date", order: str | None = None) -> DataFrame:
    """Absolute error and percentage error (as a ratio) per finite pair, with ``order`` as ``age``."""
    y, p = F.col("y_true"), F.col("y_pred")
    usable = pairs.where(F.col(date).isNotNull() & is_finite(y) & is_finite(p))
    return usable.select(
        entity,
        date,
        round_stored(F.abs(y - p), 6).alias("abs_error"),
        F.round(errors.absolute_percentage(y, p), 8).alias("ape"),
        (F.col(order) if order else F.lit(0)).cast("double").alias("age"),
    )


def append_errors(
    history: DataFrame | None, pairs: DataFrame, entity: str = "entity", date: str = "date", order: str | None = None
) -> DataFrame:
    """History with the new points; per (entity, date) the newest one wins.

    ``order`` tells which of several new points for one key is the latest. The choice is a combinable
    aggregate, so repeated keys shrink before the shuffle.
    """
    both = error_points(pairs, entity, date, order).withColumn("fresh", F.lit(1))
    if history is not None:
        old = history.select(entity, date, "abs_error", "ape")
        both = both.unionByName(old.withColumns({"age": F.lit(0.0), "fresh": F.lit(0)}))
    point = F.struct("fresh", "age", "abs_error", "ape")
    newest = both.groupBy(entity, date).agg(F.max(point).alias("point"))
    return newest.select(entity, date, "point.abs_error", "point.ape")


def cap_history(history: DataFrame, entity: str = "entity", date: str = "date", limit: int | None = None) -> DataFrame:
    """The newest ``limit`` points by (date, entity), a top-k in which each task hands over at most so many rows.

    Without a limit the whole history stays.
    """
    return history if limit is None else history.orderBy(F.col(date).desc(), F.col(entity).desc()).limit(limit)


def _blocks(history: DataFrame, reach: int, entity: str, date: str, size: int) -> DataFrame:
    """The history in the order (date, entity), cut into blocks that can be windowed apart.

    Adds ``_at`` (position from 1) and ``_block``. The ``reach`` rows before a block are copied into it, with
    ``_own`` false. Only the counts per date are ordered globally; a date's rows are ranked among themselves.
    """
    days = history.groupBy(F.col(date).alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(F.lit(0)).orderBy("_day")) - F.col("_rows")  # one row per day
    rank = F.row_number().over(W.partitionBy(date).orderBy(entity))
    placed = history.withColumn("_rank", rank).join(days.select("_day", before.alias("_before")), F.col(date) == F.col("_day"))
    at = F.col("_before") + F.col("_rank")
    block = F.floor((at - 1) / size)
    near_end = F.pmod(at - 1, F.lit(size)) >= size - reach
    blocks = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = placed.withColumn("_at", at).withColumn("_home", block).withColumn("_block", F.explode(blocks))
    return dealt.withColumn("_own", F.col("_block") == F.col("_home")).drop("_rank", "_before", "_day", "_home")


def rolling_error_series(
    history: DataFrame, window: int, entity: str = "entity", date: str = "date", per_entity: bool = True,
    bounds: tuple[int, int | None] = WINDOW_BOUNDS, block: int = BLOCK_POINTS,
) -> DataFrame:
    """Mean errors over ``window`` consecutive points, from the first full window on.

    A window outside ``bounds`` is an error. Per entity the window group is a series of days; across entities the one
    order of all points is cut into blocks of ``block`` rows, so no task holds more.
    """
    w, (least, most) = int(window), bounds
    if w < least or (most is not None and w > most):
        raise ValueError(f"A rolling window of {w} points is outside {least} to {most}.")
    if per_entity:
        order = W.partitionBy(entity).orderBy(date)
        points = history.withColumns({"_at": F.row_number().over(order), "_own": F.lit(True)})
    else:
        points = _blocks(history, w - 1, entity, date, max(block, w))
        order = W.partitionBy("_block").orderBy("_at")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    running = {}
    for c in ("abs_error", "ape"):
        value = F.col(c).cast("decimal(28,8)")
        running[f"_sum_{c}"] = F.coalesce(F.sum(value).over(upto).cast("decimal(36,8)"), F.lit(0).cast("decimal(36,8)"))
        running[f"_n_{c}"] = F.count(value).over(upto)
    points = points.withColumns(running)

    def exact_mean(c: str) -> Column:
        """Stored errors have few digits; decimal sums keep a mean on a rounding edge where it is.

        A window's sum is the difference of two running sums, which decimals keep exact, so a row costs the same whatever ``w``.
        """
        held, n = (F.col(t) - F.coalesce(F.lag(t, w).over(order), F.lit(0).cast(k)) for t, k in ((f"_sum_{c}", "decimal(36,8)"), (f"_n_{c}", "long")))
        mean = held.cast("decimal(34,8)") / F.nullif(n, F.lit(0)).cast("decimal(10,0)")
        return mean.cast("decimal(32,12)")  # an average's type: a wider one loses digits when it is multiplied

    rolled = points.select(
        entity,
        date,
        "_at",
        "_own",
        F.round(exact_mean("abs_error"), 6).cast("double").alias("mae"),
        F.round(F.coalesce(100 * exact_mean("ape"), F.lit(0)), 4).cast("double").alias("mape"),
    )
    return rolled.where((F.col("_at") >= w) & F.col("_own") & F.col("mae").isNotNull()).drop("_at", "_own")
