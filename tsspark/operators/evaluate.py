"""Scoring forecasts against actuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.config import PromotionConfig
from tsspark.functions.texts import EVALUATION_MESSAGES
from tsspark.functions import errors
from tsspark.functions.missing import is_finite


def _three(actual: Column, forecast: Column, within: Column | None = None) -> list[Column]:
    if within is not None:
        actual, forecast = F.when(within, actual), F.when(within, forecast)
    return [
        errors.mae(actual, forecast).alias("mae"),
        errors.rmse(actual, forecast).alias("rmse"),
        errors.mape(actual, forecast).alias("mape"),
    ]


def point_metrics(actual: str = "y_true", forecast: str = "y_pred", within: Column | None = None) -> list[Column]:
    """MAE, RMSE and MAPE aggregates, optionally over the rows for which ``within`` holds."""
    return _three(F.col(actual), F.col(forecast), within)


def metrics_global(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*point_metrics())


def metrics_by_entity(pairs: DataFrame, entity: str = "entity") -> DataFrame:
    return pairs.groupBy(entity).agg(*point_metrics())


def metrics_entity_mean(pairs: DataFrame, entity: str = "entity") -> DataFrame:
    """Every entity weighs the same; one without a MAPE is left out of the MAPE mean."""
    return metrics_by_entity(pairs, entity).agg(*[F.avg(m).alias(m) for m in ("mae", "rmse", "mape")])


def align(forecasts: DataFrame, actuals: DataFrame, entity: str | None = "entity", date: str = "date", target: str = "target") -> DataFrame:
    """(entity, date, y_true, y_pred) where both sides have the day."""
    keys = [date] if entity is None else [entity, date]
    right = actuals.select(*keys, F.col(target).alias("y_true"))
    left = forecasts if entity is None else forecasts.withColumnRenamed("entity_id", entity)
    return left.select(*keys, "y_pred").join(right, keys).select(*keys, "y_true", "y_pred")


def aligned_metrics(pairs: DataFrame) -> DataFrame:
    """Scores over pairs of finite numbers; no row if there is no such pair."""
    usable = pairs.where(is_finite(F.col("y_true")) & is_finite(F.col("y_pred")))
    scored = usable.agg(F.count(F.lit(1)).alias("n_samples"), *point_metrics())
    return scored.where(F.col("n_samples") > 0)


def evaluate_forecast(
    requested: DataFrame,
    forecasts: DataFrame,
    actuals: DataFrame,
    entity: str = "entity",
    date: str = "date",
    target: str = "target",
) -> DataFrame:
    """One row per requested entity: its scores, or the first reason why there are none, as a code and a message.

    ``forecasts`` holds the latest forecast per entity. Actuals meet the (short) forecasts on
    (entity, date); whether an entity has actuals at all comes from a grouped side.
    """
    predicted = forecasts.select(F.col("entity_id").alias(entity), F.col("date").alias(date), "y_pred")
    days = actuals.select(entity, date, F.col(target).alias("y_true"))
    seen = actuals.groupBy(entity).agg(F.lit(True).alias("has_rows"))
    met = predicted.join(days, [entity, date], "left")
    good = is_finite(F.col("y_true")) & is_finite(F.col("y_pred"))
    scored = met.groupBy(entity).agg(
        F.count(F.lit(1)).alias("horizon"), F.count_if(good).alias("n_samples"), *point_metrics(within=good)
    )
    out = requested.select(entity).join(scored, entity, "left").join(seen, entity, "left")
    reason = (
        F.when(F.col("horizon").isNull(), F.lit("no_forecast_record"))
        .when(F.col("has_rows").isNull(), F.lit("no_rows_for_store"))
        .when(F.col("n_samples") == 0, F.lit("no_overlapping_dates"))
        .when(F.col("mae").isNull(), F.lit("metrics_computation_failed"))
    )
    message = F.lit(None).cast("string")
    for code, text in EVALUATION_MESSAGES.items():
        said = F.format_string(text, F.col(entity).cast("string")) if "%s" in text else F.lit(text)
        message = F.when(reason == code, said).otherwise(message)
    return out.select(
        entity,
        F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("no_ground_truth")).alias("status"),
        reason.alias("reason"),
        message.alias("message"),
        F.coalesce("horizon", F.lit(0)).alias("horizon"),
        F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        "mae",
        "rmse",
        "mape",
    )


def latest_forecasts(records: DataFrame, at: str = "recorded_at") -> DataFrame:
    """Points of the newest record per entity; a date repeated inside it keeps its last value.

    ``records``: (entity_id, recorded_at, step, date, y_pred). Both steps are combinable aggregates.
    """
    newest = records.groupBy("entity_id").agg(F.max(at).alias(at))
    return (
        records.join(newest, ["entity_id", at])
        .groupBy("entity_id", "date", at)
        .agg(F.max_by("y_pred", "step").alias("y_pred"), F.max("step").alias("step"))
    )


def backtest_error_series(splits: DataFrame, entity: str = "entity") -> DataFrame:
    """(cutoff_date, metric, value) per split, with the total number of scored points per entity."""
    totals = splits.withColumn("total_samples", F.sum("horizon").over(W.partitionBy(entity)))  # twenty rows at most
    return totals.unpivot([entity, "cutoff_date", "total_samples"], ["mae", "mape"], "metric", "value")


def historical_metrics(
    forecasts: DataFrame,
    actuals: DataFrame,
    start: str,
    end: str,
    entity: str = "entity",
    date: str = "date",
    target: str = "target",
    model_version: str = "v1",
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Actual, forecast and error side by side; the range reaches both scans before the join."""
    span = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    left = actuals.select(F.col(entity).alias("series_id"), F.col(date).alias("date"), F.col(target).alias("actual")).where(span)
    right = forecasts.select(F.col("entity_id").alias("series_id"), "date", F.col("y_pred").alias("forecast")).where(span)
    if wanted is not None:
        ids = wanted.select(F.col(entity).alias("series_id"))
        left, right = (side.join(ids, "series_id", "left_semi") for side in (left, right))
    both = left.join(right, ["series_id", "date"], "full")
    return both.select(
        "series_id",
        "date",
        "actual",
        "forecast",
        (F.col("actual") - F.col("forecast")).alias("error"),
        F.lit(model_version).alias("model_version"),
    )


def metric_series(pairs: DataFrame, metric: str, granularity: str = "daily", date: str = "date") -> DataFrame:
    """One metric over time, per day or per week (weeks start on Monday)."""
    units = {"daily": "day", "weekly": "week"}
    if granularity not in units:
        raise ValueError(f"granularity must be one of {sorted(units)}")
    named = dict(zip(("mae", "rmse", "mape"), point_metrics(), strict=True))
    if metric not in named:
        raise ValueError(f"metric must be one of {sorted(named)}")
    period = F.date_trunc(units[granularity], F.col(date).cast("timestamp_ntz")).cast("date")
    return pairs.groupBy(period.alias("date")).agg(named[metric].alias("value"))


def forecast_vs_actual(
    forecasts: DataFrame,
    actuals: DataFrame,
    baseline: DataFrame | None = None,
    entity: str = "entity",
    date: str = "date",
    target: str = "target",
) -> DataFrame:
    keys = ["entity_id", "date"]
    out = forecasts.select(*keys, F.col("y_pred").alias("forecast"))
    right = actuals.select(F.col(entity).alias("entity_id"), F.col(date).alias("date"), F.col(target).alias("actual"))
    out = out.join(right, keys, "left")
    if baseline is not None:
        out = out.join(baseline.select(*keys, F.col("y_pred").alias("baseline")), keys, "left")
    return out


def promotion_gate(metrics: DataFrame, limits: PromotionConfig = PromotionConfig()) -> DataFrame:
    """Whether each metric is within its limit, and all of them; an unknown metric does not pass."""
    checks = {"mae": limits.mae_max, "rmse": limits.rmse_max, "mape": limits.mape_max}
    passed = {f"{m}_ok": F.coalesce(F.col(m) <= limit, F.lit(False)) for m, limit in checks.items()}
    every = F.col("mae_ok") & F.col("rmse_ok") & F.col("mape_ok")
    return metrics.withColumns(passed).withColumn("promote", every)
