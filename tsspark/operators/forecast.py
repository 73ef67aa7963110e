"""Splits, the seasonal-naive model, intervals, and what surrounds a forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.functions.offsets import advance
from tsspark.functions.rounding import round_stored

NAIVE_NAME = "seasonal_naive"


def split_date(df: DataFrame, share: float, date: str = "date") -> Column:
    """First validation date, as a scalar subquery; NULL if there is nothing to split.

    The set of dates is as long as the calendar, whatever the number of rows.
    """
    if not 0 < share < 1:
        return F.lit(None).cast("date")
    dates = F.sort_array(F.collect_set(F.col(date).cast("date")))
    cut = F.floor(F.size(dates) * F.lit(1 - share)).cast("int")
    return df.agg(F.when(F.size(dates) >= 2, F.get(dates, cut)).alias("cutoff")).scalar()


def time_split(df: DataFrame, share: float = 0.2, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(train, validation): rows before, and from, the date that leaves ``share`` of the dates."""
    cutoff = split_date(df, share, date)
    return df.where(cutoff.isNull() | (F.col(date) < cutoff)), df.where(F.col(date) >= cutoff)


def label_split(df: DataFrame, share: float = 0.2, date: str = "date") -> DataFrame:
    part = F.when(F.col(date) >= split_date(df, share, date), F.lit("validation")).otherwise(F.lit("train"))
    return df.withColumn("split", part)


def last_rows(
    df: DataFrame, k: int, entity: str | None = "entity", date: str = "date", target: str = "target", extra: tuple[str, ...] = ()
) -> DataFrame:
    """One row per entity: its last ``k`` values in date order, with the last date and last ``extra``.

    Map tasks keep k rows per entity before the shuffle, so what moves is entities x k. Without an entity the table is
    one series and gives one row, from a top-k in which each task hands over k rows.
    """
    keys = [entity] if entity else []
    narrow = df.select(*keys, date, target, *extra)
    if entity:
        newest = F.row_number().over(W.partitionBy(entity).orderBy(F.col(date).desc()))
        tail = narrow.withColumn("_back", newest).where(F.col("_back") <= k)
    else:
        tail = narrow.orderBy(F.col(date).desc()).limit(k)
    rows = F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(target).cast("double").alias("y"))))
    return tail.groupBy(*keys).agg(
        F.transform(rows, lambda r: r["y"]).alias("hist"),
        F.max(date).alias("last_date"),
        *[F.max_by(c, date).alias(c) for c in extra],
    )


def seasonal_naive(
    df: DataFrame,
    horizon: int,
    k: int = 7,
    entity: str | None = "entity",
    date: str = "date",
    target: str = "target",
    step_days: int = 1,
    offset: str | None = None,
    report_short: bool = False,
) -> DataFrame:
    """Repeat the last ``k`` rows forward from the last date; forecast dates are ``step_days`` or an ``offset`` apart.

    Entities with fewer rows give no row, or with ``report_short`` one row without a forecast (step 0) and, as for all
    rows, a ``status``. Without an entity the table is one series and ``entity_id`` is NULL.
    """
    if horizon < 1 or k < 1 or step_days < 1:
        raise ValueError("horizon, seasonality and step_days must be >= 1")
    last = last_rows(df, k, entity, date, target).where(F.size("hist") > 0)
    enough = F.size("hist") == k
    ahead = F.when(enough, F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.array(F.lit(0)))
    steps = (last if report_short else last.where(enough)).select("*", F.explode(ahead).alias("step"))
    status = F.when(F.col("step") > 0, F.lit("ok")).otherwise(F.lit("insufficient_history"))
    made = F.col("step") > 0
    return steps.select(
        (F.col(entity) if entity else F.lit(None).cast("string")).alias("entity_id"),
        F.when(made, advance(F.col("last_date"), F.col("step"), offset or f"{step_days}D")).alias("date"),
        F.when(made, F.get("hist", (F.col("step") - 1) % k)).alias("y_pred"),
        F.lit(NAIVE_NAME).alias("model_name"),
        "step",
        *([status.alias("status")] if report_short else []),
    )


def short_series(df: DataFrame, k: int, entity: str = "entity") -> DataFrame:
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where(F.col("n_rows") < k)


def with_interval(df: DataFrame, residual_std: Column | float | None, z: float = 1.96, point: str = "y_pred") -> DataFrame:
    """Symmetric bounds, or NULL if the spread is unknown or not positive."""
    spread = residual_std if isinstance(residual_std, Column) else F.lit(residual_std).cast("double")
    reach = F.when(spread > 0, z * spread)
    exact = df.withColumns({"confidence_low": F.col(point) - reach, "confidence_high": F.col(point) + reach})
    return exact.withColumns({c: round_stored(F.col(c), 2) for c in ("confidence_low", "confidence_high")})


def residual_std(validation: DataFrame, training: DataFrame, actual: str = "y_true", forecast: str = "y_pred") -> DataFrame:
    """One row: spread of the validation residuals, or of the training ones if there are none."""
    gap = F.stddev_pop(F.col(actual) - F.col(forecast)).alias("spread")
    held_out, in_sample = validation.agg(gap).scalar(), training.agg(gap).scalar()
    chosen = F.coalesce(held_out, in_sample)
    source = F.when(held_out.isNotNull(), F.lit("validation")).otherwise(F.lit("training"))
    found = training.sparkSession.range(1).select(chosen.alias("residual_std"), source.alias("source"))
    return found.select(round_stored(F.col("residual_std"), 4).alias("residual_std"), "source")


def history_guard(df: DataFrame, max_lag: int, min_rows: int = 15, entity: str = "entity") -> DataFrame:
    """Row count, required rows and verdict per entity, so that one short series does not fail a job."""
    required = max(max_lag, min_rows)
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("n_rows") < required, F.lit("insufficient_history")).otherwise(F.lit("ok"))
    return counts.select(entity, "n_rows", F.lit(required).alias("required"), status.alias("status"))


def known_entities(requested: DataFrame, panel: DataFrame, entity: str = "entity") -> DataFrame:
    """Requested ids with ``known``; the panel's ids are grouped before they are joined."""
    ids = panel.groupBy(entity).agg(F.lit(True).alias("known"))
    return requested.join(ids, entity, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def last_observed_date(df: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    return df.groupBy(entity).agg(F.max(date).alias("last_date"))


def check_bounds(horizon: int, n_splits: int = 1, max_horizon: int = 60, max_splits: int = 20) -> None:
    """Bounds of what a caller may ask for."""
    if not 1 <= horizon <= max_horizon:
        raise ValueError(f"horizon must be between 1 and {max_horizon}, got {horizon}.")
    if not 1 <= n_splits <= max_splits:
        raise ValueError(f"n_splits must be between 1 and {max_splits}, got {n_splits}.")


def forecast_arrays(forecasts: DataFrame, level: float = 0.95, model_version: str = "v1") -> DataFrame:
    """One row per series with its steps and bounds as arrays in step order (bounded by the horizon)."""
    point = F.struct("step", "y_pred", "confidence_low", "confidence_high")
    rows = forecasts.groupBy("entity_id").agg(F.sort_array(F.collect_list(point)).alias("rows"))
    return rows.select(
        F.col("entity_id").alias("series_id"),
        F.lit(model_version).alias("model_version"),
        F.lit("D").alias("frequency"),
        F.lit(level).alias("interval_level"),
        F.col("rows.step").alias("steps"),
        F.col("rows.y_pred").alias("point_forecast"),
        F.col("rows.confidence_low").alias("lower"),
        F.col("rows.confidence_high").alias("upper"),
    )
