"""Performance monitoring, alerts and status summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.config import MonitorConfig
from tsspark.operators.backtest import split_averages
from tsspark.operators.evaluate import point_metrics

WARNING_RATIO = 0.8
MODEL_NAME = "gbt"


def performance_monitor(
    pairs: DataFrame, config: MonitorConfig = MonitorConfig(), date: str = "date", entity: str | None = None
) -> DataFrame:
    """One row: scores over everything and over the last days, with alerts on the latter.

    Both come from one pass; with ``entity`` every entity weighs the same.
    """
    newest = pairs.agg(F.max(F.col(date).cast("date"))).scalar()
    recent = F.col(date).cast("date") >= F.date_sub(newest, config.window_days - 1)
    late = [c for c in point_metrics(within=recent)]
    named = [*point_metrics(), *[c.alias(f"rolling_{n}") for c, n in zip(late, ("mae", "rmse", "mape"), strict=True)]]
    points = F.count_if(recent).alias("evaluated_points")
    if entity is None:
        scored = pairs.agg(*named, points)
    else:
        per_entity = pairs.groupBy(entity).agg(*named, points)
        means = [F.avg(m).alias(m) for p in ("", "rolling_") for m in (f"{p}mae", f"{p}rmse", f"{p}mape")]
        scored = per_entity.agg(*means, F.coalesce(F.sum("evaluated_points"), F.lit(0)).alias("evaluated_points"))
    return scored.select(
        "mae", "rmse", "mape", "rolling_mae", "rolling_mape", "evaluated_points",
        F.lit(config.window_days).alias("window_size"),
        _exceeds(F.col("rolling_mae"), config.mae_alert).alias("alert_mae"),
        _exceeds(F.col("rolling_mape"), config.mape_alert).alias("alert_mape"),
    )


def _exceeds(value: Column, limit: float) -> Column:
    """An unknown value never alerts."""
    return F.coalesce((value > limit) & ~F.isnan(value), F.lit(False))


def monitoring_status(
    performance: DataFrame, drift: DataFrame, model_name: str = MODEL_NAME, version: str = "", ratio: float = WARNING_RATIO
) -> DataFrame:
    """Critical on any performance alert or drift, warning close to the drift threshold, else healthy."""
    moved = drift.select(F.struct("drift_detected", "overall_score", "threshold")).scalar()
    joined = performance.withColumn("drift", moved)
    alarm = F.col("alert_mae") | F.col("alert_mape") | F.coalesce(F.col("drift.drift_detected"), F.lit(False))
    close = F.col("drift.overall_score") >= F.col("drift.threshold") * ratio
    status = F.when(alarm, F.lit("critical")).when(close, F.lit("warning")).otherwise(F.lit("healthy"))
    return joined.select(
        F.lit(model_name).alias("model_name"),
        F.lit(version).alias("version"),
        *performance.columns,
        "drift.drift_detected",
        "drift.overall_score",
        "drift.threshold",
        status.alias("overall_status"),
    )


def service_alerts(rows: DataFrame, config: MonitorConfig = MonitorConfig()) -> DataFrame:
    """Alert flags for rows with mae, mape, drift_detected and overall_score; warning or healthy."""
    drifted = F.coalesce("drift_detected", F.lit(False)) | _exceeds(F.col("overall_score"), config.drift_threshold)
    flagged = rows.withColumns(
        {
            "alert_mae": _exceeds(F.col("mae"), config.mae_alert),
            "alert_mape": _exceeds(F.col("mape"), config.mape_alert),
            "alert_drift": drifted,
        }
    )
    any_alert = F.col("alert_mae") | F.col("alert_mape") | F.col("alert_drift")
    return flagged.withColumn("overall_status", F.when(any_alert, F.lit("warning")).otherwise(F.lit("healthy")))


def _with_drift(rows: DataFrame, drift: DataFrame) -> DataFrame:
    fields = ("drift_detected", "overall_score", "threshold", "per_feature_scores")
    found = drift.select(F.struct(*fields)).scalar()
    return rows.withColumn("_drift", found).select(*rows.columns, *[F.col(f"_drift.{f}") for f in fields])


_POINTS = "array<struct<date:string,value:double>>"


def monitoring_from_validation(record: DataFrame, drift: DataFrame, config: MonitorConfig = MonitorConfig()) -> DataFrame:
    """Monitoring row seeded from a run record's validation metrics and a drift row."""
    seeded = record.select(
        F.lit(MODEL_NAME).alias("model_name"),
        F.col("model_version").alias("version"),
        F.col("validation_metrics.mae").alias("mae"),
        F.col("validation_metrics.rmse").alias("rmse"),
        F.col("validation_metrics.mape").alias("mape"),
        F.col("sample_size").alias("evaluated_points"),
        F.lit("validation_holdout").alias("source"),
        F.array().cast(_POINTS).alias("mae_series"),
        F.array().cast(_POINTS).alias("mape_series"),
        F.col("trained_at").alias("last_training"),
    )
    flagged = service_alerts(_with_drift(seeded, drift), config)
    return flagged.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in ("mae", "rmse", "mape")})


def monitoring_from_backtest(
    splits: DataFrame,
    drift: DataFrame,
    version: str = "unknown",
    entity: str = "entity",
    config: MonitorConfig = MonitorConfig(),
) -> DataFrame:
    """One monitoring row per entity from its backtest splits; replaces earlier rows when written.

    The series arrays hold one point per split (twenty at most).
    """

    def series(metric: str) -> Column:
        points = F.sort_array(F.collect_list(F.struct("split", "cutoff_date", metric)))
        return F.transform(points, lambda p: F.struct(p["cutoff_date"].cast("string").alias("date"), p[metric].alias("value")))

    per_entity = splits.groupBy(entity).agg(
        *split_averages(),
        F.sum("horizon").alias("evaluated_points"),
        series("mae").alias("mae_series"),
        series("mape").alias("mape_series"),
    )
    joined = per_entity.select(
        entity,
        F.lit(MODEL_NAME).alias("model_name"),
        F.lit(version).alias("version"),
        "mae",
        "rmse",
        "mape",
        "evaluated_points",
        "n_splits",
        F.lit("rolling_backtest").alias("source"),
        "mae_series",
        "mape_series",
        F.lit(None).cast("string").alias("last_training"),
    )
    flagged = service_alerts(_with_drift(joined, drift), config)
    return flagged.withColumn("mape", F.coalesce("mape", F.lit(0.0)))


def monitoring_summary(rows: DataFrame, config: MonitorConfig = MonitorConfig(), entity: str | None = None) -> DataFrame:
    """The nested, normalised view of monitoring rows."""
    threshold = F.coalesce("threshold", F.lit(config.drift_threshold))
    scores = F.coalesce("per_feature_scores", F.create_map().cast("map<string,double>"))
    over = F.filter(F.map_entries(scores), lambda e: e["value"] > threshold)
    indicators = F.transform(over, lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("score")))
    drifted = F.when(F.coalesce("drift_detected", F.lit(False)), F.lit("drift_detected")).otherwise(F.lit("ok"))
    state = F.when(F.col("overall_status") == "unknown", F.lit("unknown")).otherwise(F.lit("ok"))
    return rows.select(
        *([entity] if entity else []),
        F.struct("model_name", F.col("version").alias("model_version")).alias("model_info"),
        F.struct("mae", "rmse", "mape", F.col("evaluated_points").alias("sample_size"), "source").alias("performance"),
        F.struct(
            drifted.alias("status"),
            F.sort_array(indicators).alias("indicators"),
            "overall_score",
            threshold.alias("threshold"),
            scores.alias("per_feature_scores"),
        ).alias("drift"),
        F.struct("last_training", F.lit(None).cast("string").alias("last_etl"), state.alias("status")).alias("pipeline"),
        F.struct(F.col("mae_series").alias("mae"), F.col("mape_series").alias("mape")).alias("rolling_series"),
        F.struct(F.col("alert_mae").alias("mae"), F.col("alert_mape").alias("mape"), F.col("alert_drift").alias("drift")).alias("alerts"),
        F.struct(
            F.lit(config.mae_alert).alias("mae_alert"),
            F.lit(config.mape_alert).alias("mape_alert"),
            F.lit(config.drift_threshold).alias("drift_threshold"),
        ).alias("thresholds"),
        "overall_status",
    )


def evaluation_snapshot(rows: DataFrame, record: DataFrame | None = None, entity: str | None = None) -> DataFrame:
    """Current metrics beside the validation metrics of the run record, if there is one."""
    empty = F.lit(None).cast("struct<rmse:double,mae:double,mape:double>")
    held = record.select("validation_metrics").scalar() if record is not None else empty
    return rows.withColumn("_held", held).select(
        *([entity] if entity else []),
        F.col("version").alias("model_version"),
        "mae",
        "rmse",
        "mape",
        F.col("evaluated_points").alias("sample_size"),
        F.col("_held.mae").alias("validation_mae"),
        F.col("_held.rmse").alias("validation_rmse"),
        F.col("_held.mape").alias("validation_mape"),
        "source",
    )


def alert_rows(rows: DataFrame, config: MonitorConfig = MonitorConfig(), entity: str | None = None) -> DataFrame:
    """One row per raised alert."""
    kinds = (
        ("MAE", "alert_mae", "mae", config.mae_alert),
        ("MAPE", "alert_mape", "mape", config.mape_alert),
        ("Drift", "alert_drift", "overall_score", config.drift_threshold),
    )
    listed = F.array(
        *[
            F.struct(
                F.lit(kind).alias("alert_type"), F.col(flag).alias("raised"),
                F.col(value).alias("current_value"), F.lit(limit).alias("threshold"),
            )
            for kind, flag, value, limit in kinds
        ]
    )
    return rows.select(*([entity] if entity else []), F.inline(listed)).where("raised").drop("raised")


def empty_summary(entities: DataFrame, rows: DataFrame, config: MonitorConfig = MonitorConfig(), entity: str = "entity") -> DataFrame:
    """Monitoring rows for all listed entities; a neutral row where no run exists."""
    joined = entities.select(entity).join(rows, entity, "left")
    unseen = F.col("overall_status").isNull()
    defaults = {
        "model_name": F.lit(""),
        "version": F.lit("unknown"),
        "evaluated_points": F.lit(0),
        "source": F.lit("none"),
        "drift_detected": F.lit(False),
        "overall_score": F.lit(0.0),
        "threshold": F.lit(config.drift_threshold),
        "alert_mae": F.lit(False),
        "alert_mape": F.lit(False),
        "alert_drift": F.lit(False),
    }
    note = F.when(unseen, F.lit("no run recorded"))
    filled = {c: F.coalesce(c, v) for c, v in defaults.items() if c in rows.columns}
    status = F.coalesce("overall_status", F.lit("unknown"))
    return joined.withColumn("note", note).withColumns({**filled, "overall_status": status})


def last_activity(records: DataFrame, at: str = "recorded_at") -> DataFrame:
    """Newest forecast per entity: its horizon and time."""
    newest = F.max_by("horizon", F.struct(at, "horizon")).alias("horizon")
    return records.groupBy("entity_id").agg(newest, F.max(at).alias("at"))
