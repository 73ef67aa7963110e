"""Rolling-origin backtests for all entities at once.

The panel is numbered once per entity. A row near a cutoff joins that split's group, as one of the last k
values up to it or of the next H rows after it; all other rows are dropped before anything is collected.
There is no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.config import ForecastConfig
from tsspark.functions.rounding import round_stored
from tsspark.functions import errors

DEFAULTS = ForecastConfig()


def _ranges(n: Column, horizon: int, first: int, strict: bool) -> tuple[Column, Column]:
    """(last cutoff position, number of positions after the first one)."""
    last = n - horizon - (1 if strict else 0)
    return last, last - first


def _cutoff_positions(n: Column, horizon: int, n_splits: int, first: int, strict: bool) -> Column:
    """Evenly spaced positions, rounded half to even; NULL if the series is too short."""
    last, room = _ranges(n, horizon, first, strict)
    splits = F.least(F.lit(n_splits), room).cast("int")
    spread = F.transform(
        F.sequence(F.lit(0), splits - 1),
        lambda i: (F.lit(first) + F.bround(i * (room / F.nullif(splits - 1, F.lit(0))), 0)).cast("int"),
    )
    return F.when(room > 0, F.when(splits == 1, F.array(last.cast("int"))).otherwise(spread))


def _maybe_near(at: Column, n: Column, horizon: int, n_splits: int, tail: int, first: int, strict: bool) -> Column:
    """Whether a row may be near one of the cutoffs, give or take a position: plain arithmetic that spares most rows the arrays."""
    last, room = _ranges(n, horizon, first, strict)
    splits = F.least(F.lit(n_splits), room)
    step = room / F.nullif(splits - 1, F.lit(0))  # at least 1
    lowest, highest = F.ceil((at - (horizon + 2 + first)) / step), F.floor((at + (tail + 2 - first)) / step)
    some = F.greatest(lowest, F.lit(0)) <= F.least(highest, splits - 1)
    one = (at >= last - (tail + 1)) & (at <= last + (horizon + 1))
    return (room > 0) & F.when(splits == 1, one).otherwise(some)


def backtest_cutoffs(
    df: DataFrame,
    horizon: int,
    n_splits: int,
    entity: str = "entity",
    first: int = DEFAULTS.min_history,
    strict: bool = False,
) -> DataFrame:
    """(entity, n_dates, status, split, cutoff position); a short series gives one row with a status.

    ``strict`` makes sure that a full horizon lies behind every cutoff; by default the last one has one
    row less.
    """
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).cast("int").alias("n_dates"))
    positions = _cutoff_positions(F.col("n_dates"), horizon, n_splits, first, strict)
    listed = counts.withColumn("positions", positions)
    status = F.when(F.col("positions").isNull(), F.lit("not_enough_dates")).otherwise(F.lit("ok"))
    return listed.select(entity, "n_dates", status.alias("status"), F.posexplode_outer("positions").alias("at", "cutoff")).select(
        entity, "n_dates", "status", F.coalesce(F.col("at") + 1, F.lit(0)).alias("split"), F.coalesce("cutoff", F.lit(-1)).alias("cutoff")
    )


def cutoff_rows(
    df: DataFrame,
    horizon: int,
    n_splits: int,
    tail: int,
    entity: str = "entity",
    date: str = "date",
    target: str = "target",
    first: int = DEFAULTS.min_history,
    strict: bool = False,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (entity, split) with ``hist`` (last values) and ``ahead`` (next rows as date, y).

    A row takes part in the splits whose cutoff is near it, mostly none, so that only such rows are collected. The groups
    are parts of an entity, which the window has brought together already.
    """
    series = W.partitionBy(entity)
    at, cut = F.col("_at"), F.col("_hit.cut")
    placed = df.select(
        entity,
        date,
        *extra,
        F.col(target).cast("double").alias("_y"),
        (F.row_number().over(series.orderBy(date)) - 1).alias("_at"),
        F.count(F.lit(1)).over(series).cast("int").alias("_n"),
    )
    placed = placed.where(_maybe_near(at, F.col("_n"), horizon, n_splits, tail, first, strict))
    positions = _cutoff_positions(F.col("_n"), horizon, n_splits, first, strict)
    splits = F.transform(positions, lambda p, i: F.struct((i + 1).alias("split"), p.alias("cut")))
    near = F.filter(splits, lambda s: (at > s["cut"] - tail) & (at <= s["cut"] + horizon))
    rows = placed.withColumn("_hit", F.explode(near))
    here = [F.max(F.when(at == cut, F.struct(F.col(c).alias("v"))))["v"].alias(c) for c in extra]
    groups = rows.groupBy(entity, F.col("_hit.split").alias("split")).agg(
        F.max(F.when(at == cut, F.col(date))).alias("last_date"),
        *here,
        F.sort_array(F.collect_list(F.when(at <= cut, F.struct("_at", F.col("_y").alias("y"))))).alias("_tail"),
        F.sort_array(F.collect_list(F.when(at > cut, F.struct("_at", F.col(date).alias("d"), F.col("_y").alias("y"))))).alias("_ahead"),
    )
    ahead = F.transform("_ahead", lambda r: F.struct(r["d"].alias("d"), r["y"].alias("y")))
    return groups.select(entity, "split", "last_date", *extra, F.col("_tail.y").alias("hist"), ahead.alias("ahead"))


def score_splits(scored: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows (entity, split, last_date, y_true, y_pred) to rounded split metrics."""
    y, p = F.col("y_true"), F.col("y_pred")
    return scored.groupBy(entity, "split", F.col("last_date").alias("cutoff_date")).agg(
        F.count(F.lit(1)).alias("horizon"),
        round_stored(errors.rmse(y, p), 4).alias("rmse"),
        round_stored(errors.mae(y, p), 4).alias("mae"),
        round_stored(errors.mape(y, p, usable=y != 0), 2).alias("mape"),
    )


def backtest_naive(
    df: DataFrame,
    horizon: int,
    n_splits: int,
    k: int = 7,
    entity: str = "entity",
    date: str = "date",
    target: str = "target",
    strict: bool = False,
) -> DataFrame:
    """Split metrics of the seasonal-naive model. Forecasts meet actuals by date, as gaps may occur.

    A split none of whose actual days is within the horizon gives no row.
    """
    cut = cutoff_rows(df, horizon, n_splits, k, entity, date, target, strict=strict)
    days = cut.select(entity, "split", "last_date", "hist", F.inline("ahead"))
    step = F.datediff("d", "last_date")
    scored = days.where((step <= horizon) & F.col("y").isNotNull()).select(
        entity, "split", "last_date", F.col("y").alias("y_true"), F.get("hist", (step - 1) % k).alias("y_pred")
    )
    return score_splits(scored, entity)


def split_averages() -> list[Column]:
    """Number of splits and means of the rounded split metrics; undefined MAPEs are left out.

    The means are taken over decimals, so a mean on a rounding edge stays there.
    """

    def exact_mean(metric: str, digits: int) -> Column:
        return F.round(F.avg(F.col(metric).cast("decimal(28,4)")), digits).cast("double").alias(metric)

    return [F.count(F.lit(1)).alias("n_splits"), exact_mean("rmse", 4), exact_mean("mae", 4), exact_mean("mape", 2)]


def backtest_average(splits: DataFrame, entity: str = "entity") -> DataFrame:
    return splits.groupBy(entity).agg(*split_averages())
