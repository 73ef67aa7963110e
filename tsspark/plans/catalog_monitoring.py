"""Registered queries: performance monitoring, alerts, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsspark.config import MonitorConfig
from tsspark.operators import drift as D
from tsspark.operators import evaluate as E
from tsspark.operators import monitor as M
from tsspark.plans.catalog import MAE_SQL, MAPE_SQL, RMSE_SQL, SALES, query, with_
from tsspark.plans.catalog_drift import DRIFT, ENTITY_DRIFT, OVERALL, sales_measures
from tsspark.plans.catalog_evaluation import (
    AVERAGES, BY_ENTITY, PAIRS, SALES_SPLITS, forecast_records, sales_pairs, sales_splits,
)
from tsspark.plans.catalog_models import RECORD_CTES, _naive_record, _sales
from tsspark.sources import panels

CONFIG = MonitorConfig(mae_alert=16.0, mape_alert=150.0, window_days=90)
# the same limits as SQL
LIMITS = {"mae": 16.0, "mape": 150.0, "drift": 0.25}


MONITORED = f"""SELECT {{keys}} {MAE_SQL} AS mae, {RMSE_SQL} AS rmse, {MAPE_SQL} AS mape,
    avg(abs(y_true - y_pred)) FILTER (date >= newest - 89) AS rolling_mae,
    avg(CASE WHEN abs(y_true) > 1e-10 THEN abs((y_true - y_pred) / y_true) END) FILTER (date >= newest - 89) * 100 AS rolling_mape,
    count(*) FILTER (date >= newest - 89) AS evaluated_points
    FROM pairs, (SELECT max(date) AS newest FROM pairs) {{group}}"""
PERFORMANCE = f"performance AS ({MONITORED.format(keys='', group='')})"
PERFORMANCE_MEAN = f"""performance AS (
    SELECT avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(rolling_mae) AS rolling_mae, avg(rolling_mape) AS rolling_mape,
           CAST(sum(evaluated_points) AS BIGINT) AS evaluated_points FROM ({MONITORED.format(keys='entity,', group='GROUP BY entity')}))"""
SHOW_PERFORMANCE = f"""round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(rolling_mae, 6) AS rolling_mae,
    round(rolling_mape, 6) AS rolling_mape, evaluated_points, 90 AS window_size,
    coalesce(rolling_mae > {LIMITS['mae']}, false) AS alert_mae, coalesce(rolling_mape > {LIMITS['mape']}, false) AS alert_mape"""


@query("performance_monitor", with_(*PAIRS, PERFORMANCE, f"SELECT {SHOW_PERFORMANCE} FROM performance"))
def performance_monitor(spark, sf_dir):
    return M.performance_monitor(sales_pairs(spark, sf_dir), CONFIG)


@query("performance_monitor_entity_mean", with_(*PAIRS, PERFORMANCE_MEAN, f"SELECT {SHOW_PERFORMANCE} FROM performance"))
def performance_monitor_entity_mean(spark, sf_dir):
    return M.performance_monitor(sales_pairs(spark, sf_dir), CONFIG, entity="entity")


@query(
    "monitoring_status",
    with_(
        *PAIRS, PERFORMANCE, *DRIFT, OVERALL,
        f"""SELECT 'gbt' AS model_name, 'v1' AS version, p.*, drift_detected, round(overall_score, 6) AS overall_score, threshold,
                   CASE WHEN alert_mae OR alert_mape OR drift_detected THEN 'critical'
                        WHEN overall_score >= threshold * 0.8 THEN 'warning' ELSE 'healthy' END AS overall_status
            FROM (SELECT {SHOW_PERFORMANCE} FROM performance) p, overall""",
    ),
)
def monitoring_status(spark, sf_dir):
    performance = M.performance_monitor(sales_pairs(spark, sf_dir), CONFIG)
    return M.monitoring_status(performance, D.feature_drift(sales_measures(spark, sf_dir)), version="v1")


def _entity_rows(spark, sf_dir):
    scores = E.metrics_by_entity(sales_pairs(spark, sf_dir))
    moved = D.distribution_drift_by_entity(_sales(spark, sf_dir)).select(
        "entity", F.col("drift_score").alias("overall_score"), (F.col("drift_score") > CONFIG.drift_threshold).alias("drift_detected")
    )
    return M.service_alerts(scores.join(moved, "entity", "left"), CONFIG)


FLAGS = f"""coalesce(mae > {LIMITS['mae']}, false) AS alert_mae, coalesce(mape > {LIMITS['mape']}, false) AS alert_mape,
            coalesce(overall_score > {LIMITS['drift']}, false) AS alert_drift"""
ALERTED = f"""alerted AS (SELECT *, {FLAGS}, CASE WHEN coalesce(mae > {LIMITS['mae']}, false) OR coalesce(mape > {LIMITS['mape']}, false)
                                 OR coalesce(overall_score > {LIMITS['drift']}, false) THEN 'warning' ELSE 'healthy' END AS overall_status FROM unflagged)"""
ENTITY_ROWS = (
    *PAIRS, BY_ENTITY, *ENTITY_DRIFT,
    "unflagged AS (SELECT b.*, score AS overall_score, score > 0.25 AS drift_detected FROM by_entity b LEFT JOIN entity_drift d ON b.entity = d.entity)",
    ALERTED,
)


@query(
    "service_alerts",
    with_(*ENTITY_ROWS, """SELECT entity, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(overall_score, 6) AS overall_score,
          drift_detected, alert_mae, alert_mape, alert_drift, overall_status FROM alerted"""),
)
def service_alerts(spark, sf_dir):
    return _entity_rows(spark, sf_dir)


@query(
    "alert_rows",
    with_(
        *ENTITY_ROWS,
        f"""SELECT entity, 'MAE' AS alert_type, round(mae, 6) AS current_value, CAST({LIMITS['mae']} AS DOUBLE) AS threshold FROM alerted WHERE alert_mae
            UNION ALL SELECT entity, 'MAPE', round(mape, 6), {LIMITS['mape']} FROM alerted WHERE alert_mape
            UNION ALL SELECT entity, 'Drift', round(overall_score, 6), {LIMITS['drift']} FROM alerted WHERE alert_drift""",
    ),
)
def alert_rows(spark, sf_dir):
    return M.alert_rows(_entity_rows(spark, sf_dir), CONFIG, entity="entity")


def _seeded(spark, sf_dir):
    return M.monitoring_from_validation(_naive_record(spark, sf_dir), D.feature_drift(sales_measures(spark, sf_dir)), CONFIG)


SEEDED = (
    *RECORD_CTES, *DRIFT, OVERALL,
    """unflagged AS (SELECT scores_v.*, overall.*, (SELECT count(*) FROM train WHERE target IS NOT NULL AND lag_14 IS NOT NULL AND rolling_std_7 IS NOT NULL)
       AS evaluated_points FROM validation scores_v, overall)""",
    ALERTED,
)
# the run record and the drift scores both call a CTE "scores"; the record's one is renamed here
SEEDED = tuple(c.replace("scores AS (SELECT round_even", "validation AS (SELECT round_even") for c in SEEDED)


@query(
    "monitoring_from_validation",
    with_(
        *SEEDED,
        """SELECT 'gbt' AS model_name, 'v1' AS version, mae, rmse, mape, evaluated_points, 'validation_holdout' AS source,
                  '2024-01-01T00:00:00Z' AS last_training, drift_detected, round(overall_score, 6) AS overall_score, threshold,
                  alert_mae, alert_mape, alert_drift, overall_status FROM alerted""",
    ),
)
def monitoring_from_validation(spark, sf_dir):
    return _seeded(spark, sf_dir).drop("mae_series", "mape_series", "per_feature_scores")


def _from_backtest(spark, sf_dir):
    splits = sales_splits(spark, sf_dir)
    moved = D.feature_drift(sales_measures(spark, sf_dir))
    return M.monitoring_from_backtest(splits, moved, "v1", config=CONFIG)


FROM_BACKTEST = (
    *SALES_SPLITS, AVERAGES, *DRIFT, OVERALL,
    """unflagged AS (SELECT a.*, o.*, points AS evaluated_points, mae_series FROM averages a, overall o,
       (SELECT entity AS e, CAST(sum(horizon) AS BIGINT) AS points,
               string_agg(concat(cutoff_date, '=', printf('%.4f', mae)), ' ' ORDER BY split) AS mae_series FROM splits GROUP BY 1) WHERE e = a.entity)""",
    ALERTED,
)
SHOW_BACKTEST = """entity, 'gbt' AS model_name, 'v1' AS version, mae, rmse, coalesce(mape, 0) AS mape, evaluated_points, n_splits, 'rolling_backtest' AS source,
    mae_series, drift_detected, round(overall_score, 6) AS overall_score, threshold, alert_mae, alert_mape, alert_drift, overall_status"""


def _series_text(column: str):
    return F.array_join(F.transform(column, lambda p: F.concat(p["date"], F.lit("="), F.format_string("%.4f", p["value"]))), " ")


@query("monitoring_from_backtest", with_(*FROM_BACKTEST, f"SELECT {SHOW_BACKTEST} FROM alerted"))
def monitoring_from_backtest(spark, sf_dir):
    rows = _from_backtest(spark, sf_dir)
    return rows.withColumn("mae_series", _series_text("mae_series")).drop("mape_series", "per_feature_scores", "last_training")


@query(
    "monitoring_summary",
    with_(
        *FROM_BACKTEST,
        """SELECT entity, 'gbt' AS model_name, 'v1' AS model_version, mae, rmse, coalesce(mape, 0) AS mape, evaluated_points AS sample_size, 'rolling_backtest' AS source,
                  CASE WHEN drift_detected THEN 'drift_detected' ELSE 'ok' END AS drift_status, round(overall_score, 6) AS overall_score,
                  (SELECT count(*) FROM scores WHERE score > 0.25) AS n_indicators, (SELECT count(*) FROM scores) AS n_scores, 'ok' AS run_status,
                  alert_mae, alert_mape, alert_drift, CAST(16 AS DOUBLE) AS mae_limit, mae_series, overall_status FROM alerted""",
    ),
)
def monitoring_summary(spark, sf_dir):
    nested = M.monitoring_summary(_from_backtest(spark, sf_dir), CONFIG, entity="entity")
    return nested.select(
        "entity", "model_info.*", "performance.*", F.col("drift.status").alias("drift_status"), "drift.overall_score",
        F.size("drift.indicators").alias("n_indicators"), F.size("drift.per_feature_scores").alias("n_scores"),
        F.col("pipeline.status").alias("run_status"), F.col("alerts.mae").alias("alert_mae"), F.col("alerts.mape").alias("alert_mape"),
        F.col("alerts.drift").alias("alert_drift"), F.col("thresholds.mae_alert").alias("mae_limit"),
        _series_text("rolling_series.mae").alias("mae_series"), "overall_status",
    )


@query(
    "evaluation_snapshot",
    with_(
        *[c for c in SEEDED if not c.startswith(("unflagged", "alerted"))], *SALES_SPLITS[1:], AVERAGES,
        """SELECT a.entity, 'v1' AS model_version, a.mae, a.rmse, coalesce(a.mape, 0) AS mape, points AS sample_size, v.mae AS validation_mae,
                  v.rmse AS validation_rmse, v.mape AS validation_mape, 'rolling_backtest' AS source
           FROM averages a, validation v, (SELECT entity AS e, CAST(sum(horizon) AS BIGINT) AS points FROM splits GROUP BY 1) WHERE e = a.entity""",
    ),
)
def evaluation_snapshot(spark, sf_dir):
    return M.evaluation_snapshot(_from_backtest(spark, sf_dir), _naive_record(spark, sf_dir), entity="entity")


@query(
    "empty_summary",
    with_(
        *FROM_BACKTEST,
        """SELECT c_custkey AS entity, coalesce(evaluated_points, 0) AS evaluated_points, mae, rmse,
                  CASE WHEN entity IS NOT NULL THEN coalesce(mape, 0) END AS mape,
                  CASE WHEN entity IS NULL THEN 'none' ELSE 'rolling_backtest' END AS source, CASE WHEN entity IS NULL THEN 'no run recorded' END AS note,
                  coalesce(drift_detected, false) AS drift_detected, coalesce(round(overall_score, 6), 0) AS overall_score,
                  coalesce(alert_mae, false) AS alert_mae, coalesce(overall_status, 'unknown') AS overall_status
           FROM customer LEFT JOIN alerted ON entity = c_custkey""",
    ),
)
def empty_summary(spark, sf_dir):
    entities = panels.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    rows = M.empty_summary(entities, _from_backtest(spark, sf_dir), CONFIG)
    return rows.select(
        "entity", "evaluated_points", "mae", "rmse", "mape", "source", "note", "drift_detected", "overall_score", "alert_mae", "overall_status"
    )


@query(
    "last_activity",
    with_(
        SALES,
        """SELECT entity AS entity_id, arg_max(horizon, month) AS horizon, CAST(max(month) AS VARCHAR) AS "at" FROM (
               SELECT entity, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS horizon FROM sales GROUP BY 1, 2) GROUP BY entity""",
    ),
)
def last_activity(spark, sf_dir):
    records = forecast_records(spark, sf_dir).groupBy("entity_id", "recorded_at").agg(F.count(F.lit(1)).alias("horizon"))
    return M.last_activity(records)
