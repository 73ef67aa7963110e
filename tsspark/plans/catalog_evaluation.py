"""Registered queries: scores, forecast evaluation, error history, backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsspark.config import PromotionConfig
from tsspark.functions.texts import EVALUATION_MESSAGES
from tsspark.operators import backtest as B
from tsspark.operators import evaluate as E
from tsspark.operators import forecast as FC
from tsspark.operators import history as H
from tsspark.plans.catalog import (
    MAE_SQL, MAPE_SQL, RMSE_SQL, SALES, SEGMENTS, THREE_SQL, cutoff_cte, naive_cte, pairs_cte, query, with_,
)
from tsspark.plans.catalog_models import USER_DAYS, _sales, _segments, _user_days
from tsspark.sources import panels

PAIRS = (SALES, pairs_cte("sales"))


def sales_pairs(spark, sf_dir):
    return panels.forecast_pairs(_sales(spark, sf_dir))


# ---- scores ----------------------------------------------------------------------------------------


@query("metrics_by_entity", with_(*PAIRS, f"SELECT entity, {THREE_SQL} FROM pairs GROUP BY entity"))
def metrics_by_entity(spark, sf_dir):
    return E.metrics_by_entity(sales_pairs(spark, sf_dir))


@query("metrics_global", with_(*PAIRS, f"SELECT {THREE_SQL} FROM pairs"))
def metrics_global(spark, sf_dir):
    return E.metrics_global(sales_pairs(spark, sf_dir))


BY_ENTITY = f"by_entity AS (SELECT entity, {MAE_SQL} AS mae, {RMSE_SQL} AS rmse, {MAPE_SQL} AS mape FROM pairs GROUP BY entity)"


@query(
    "metrics_entity_mean",
    with_(*PAIRS, BY_ENTITY, "SELECT round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(mape), 6) AS mape FROM by_entity"),
)
def metrics_entity_mean(spark, sf_dir):
    return E.metrics_entity_mean(sales_pairs(spark, sf_dir))


HELD_OUT = "held_out AS (SELECT sales.* FROM sales, cut WHERE date >= cutoff)"
TRAIN = "train AS (SELECT sales.* FROM sales, cut WHERE date < cutoff)"


@query(
    "align_forecast_actual",
    with_(SALES, cutoff_cte("sales"), TRAIN, HELD_OUT, naive_cte("train", 30),
          """SELECT entity, CAST(h.date AS VARCHAR) AS date, target AS y_true, y_pred
             FROM naive f JOIN held_out h ON h.entity = f.entity_id AND h.date = f.date"""),
)
def align_forecast_actual(spark, sf_dir):
    train, held_out = FC.time_split(_sales(spark, sf_dir))
    return E.align(FC.seasonal_naive(train, 30), held_out)


@query("aligned_metrics", with_(*PAIRS, f"SELECT count(*) AS n_samples, {THREE_SQL} FROM pairs"))
def aligned_metrics(spark, sf_dir):
    """All rows of the panel; those without an earlier value have no forecast, here NaN."""
    panel = _sales(spark, sf_dir).withColumnRenamed("target", "y_true")
    known = panels.forecast_pairs(_sales(spark, sf_dir)).select("entity", "date", "y_pred")
    padded = panel.join(known, ["entity", "date"], "left").withColumn("y_pred", F.coalesce("y_pred", F.lit(float("nan"))))
    return E.aligned_metrics(padded)


def message_sql(reason: str, entity: str) -> str:
    """The message of a reason code; %s stands for the entity."""
    cases = " ".join(f"WHEN '{code}' THEN replace('{text}', '%s', CAST({entity} AS VARCHAR))" for code, text in EVALUATION_MESSAGES.items())
    return f"CASE {reason} {cases} END"


@query(
    "evaluate_forecast",
    with_(
        SALES, cutoff_cte("sales"), TRAIN, HELD_OUT, naive_cte("train", 3),
        "known AS (SELECT held_out.* FROM held_out JOIN supplier ON s_suppkey = entity WHERE s_acctbal >= 0)",
        "met AS (SELECT f.entity_id AS entity, k.target AS y_true, f.y_pred FROM naive f LEFT JOIN known k ON k.entity = f.entity_id AND k.date = f.date)",
        f"""scored AS (SELECT entity, count(*) AS horizon, count(y_true) AS n_samples, {MAE_SQL} AS mae, {RMSE_SQL} AS rmse, {MAPE_SQL} AS mape
                       FROM met GROUP BY entity)""",
        """judged AS (SELECT c_custkey AS entity, s.*, CASE WHEN s.horizon IS NULL THEN 'no_forecast_record'
                WHEN c_custkey NOT IN (SELECT entity FROM known) THEN 'no_rows_for_store'
                WHEN n_samples = 0 THEN 'no_overlapping_dates' END AS reason
             FROM customer LEFT JOIN scored s ON s.entity = c_custkey)""",
        f"""SELECT entity, CASE WHEN reason IS NULL THEN 'ok' ELSE 'no_ground_truth' END AS status, reason, {message_sql('reason', 'entity')} AS message,
                  coalesce(horizon, 0) AS horizon, coalesce(n_samples, 0) AS n_samples, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape FROM judged""",
    ),
)
def evaluate_forecast(spark, sf_dir):
    """Requested ids beyond the panel, entities without actuals, and sparse days give every reason."""
    train, held_out = FC.time_split(_sales(spark, sf_dir))
    suppliers = panels.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("entity"))
    requested = panels.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    return E.evaluate_forecast(requested, FC.seasonal_naive(train, 3), held_out.join(suppliers, "entity", "left_semi"))


RECORDS = """records AS (
    SELECT entity AS entity_id, CAST(date_trunc('month', date) AS DATE) AS recorded_at, day(date) AS step,
           CAST(date_trunc('week', date) AS DATE) AS date, target AS y_pred FROM sales)"""


def forecast_records(spark, sf_dir):
    """Every month of a series as one record, its points dated by week, so dates repeat inside it."""
    return _sales(spark, sf_dir).select(
        F.col("entity").alias("entity_id"), F.trunc("date", "month").alias("recorded_at"), F.dayofmonth("date").alias("step"),
        F.trunc("date", "week").alias("date"), F.col("target").alias("y_pred"),
    )


@query(
    "latest_forecast_per_entity",
    with_(
        SALES, RECORDS,
        """SELECT entity_id, CAST(date AS VARCHAR) AS date, CAST(recorded_at AS VARCHAR) AS recorded_at, arg_max(y_pred, step) AS y_pred, max(step) AS step
           FROM records JOIN (SELECT entity_id AS e, max(recorded_at) AS newest FROM records GROUP BY 1) ON e = entity_id AND newest = recorded_at
           GROUP BY entity_id, date, recorded_at""",
    ),
)
def latest_forecast_per_entity(spark, sf_dir):
    return E.latest_forecasts(forecast_records(spark, sf_dir))


# ---- error history ---------------------------------------------------------------------------------


def points_sql(pairs: str) -> str:
    return f"""SELECT entity, date, round(abs(y_true - y_pred), 6) AS abs_error,
                      round(CASE WHEN abs(y_true) > 1e-12 THEN abs(y_true - y_pred) / abs(y_true) ELSE 0 END, 8) AS ape FROM {pairs}"""


@query(
    "append_errors",
    with_(
        SALES, cutoff_cte("sales"), pairs_cte("sales", 7, "weekly"), pairs_cte("sales", 14, "fortnightly"),
        f"old AS ({points_sql('weekly')} , cut WHERE date < cutoff)",
        f"new AS ({points_sql('fortnightly')}, cut WHERE date >= cutoff - 365)",
        """SELECT entity, CAST(date AS VARCHAR) AS date, abs_error, ape FROM (
               SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.entity = o.entity AND n.date = o.date))""",
    ),
    digits=8,
)
def append_errors(spark, sf_dir):
    """A year of newer scores replaces and extends an older history."""
    panel = _sales(spark, sf_dir)
    cutoff = FC.split_date(panel, 0.2)
    history = H.append_errors(None, panels.forecast_pairs(panel, 7).where(F.col("date") < cutoff))
    newer = panels.forecast_pairs(panel, 14).where(F.col("date") >= F.date_sub(cutoff, 365))
    return H.append_errors(history, newer)


def error_history(spark, sf_dir):
    return H.append_errors(None, sales_pairs(spark, sf_dir))


POINTS = f"points AS ({points_sql('pairs')})"
CAPPED = "capped AS (SELECT * FROM points ORDER BY date DESC, entity DESC LIMIT 5000)"


@query("cap_history", with_(*PAIRS, POINTS, CAPPED, "SELECT entity, CAST(date AS VARCHAR) AS date, abs_error, ape FROM capped"), digits=8)
def cap_history(spark, sf_dir):
    return H.cap_history(error_history(spark, sf_dir), limit=5000)


@query("full_history", with_(*PAIRS, POINTS, "SELECT entity, CAST(date AS VARCHAR) AS date, abs_error, ape FROM points"), digits=8)
def full_history(spark, sf_dir):
    """Without a limit every point stays."""
    return H.cap_history(error_history(spark, sf_dir))


def rolled_sql(table: str, window: int, partition: str, order: str) -> str:
    """Sums of whole units, rounded half up, so that neither engine meets a binary fraction."""
    frame = f"(w ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"""SELECT entity, CAST(date AS VARCHAR) AS date, ((2 * e + {window}) // {2 * window}) / 1000000.0 AS mae,
               ((2 * p + {100 * window}) // {200 * window}) / 10000.0 AS mape FROM (
        SELECT entity, date, row_number() OVER (w) AS idx,
               CAST(sum(CAST(round(abs_error * 1000000) AS BIGINT)) OVER {frame} AS BIGINT) AS e,
               CAST(sum(CAST(round(ape * 100000000) AS BIGINT)) OVER {frame} AS BIGINT) AS p
        FROM {table} WINDOW w AS ({partition} ORDER BY {order})) WHERE idx >= {window}"""


@query("rolling_error_series", with_(*PAIRS, POINTS, rolled_sql("points", 7, "PARTITION BY entity", "date")))
def rolling_error_series(spark, sf_dir):
    return H.rolling_error_series(error_history(spark, sf_dir), 7)


@query("rolling_error_series_all", with_(*PAIRS, POINTS, rolled_sql("points", 365, "", "date, entity")))
def rolling_error_series_all(spark, sf_dir):
    """Over the whole history of all entities, in small blocks."""
    return H.rolling_error_series(error_history(spark, sf_dir), 365, per_entity=False, bounds=(2, None), block=5000)


# ---- backtests -------------------------------------------------------------------------------------


def cutoffs_cte(panel: str, horizon: int, splits: int, strict: bool = False, name: str = "cutoffs") -> str:
    last = f"n - {horizon}" + (" - 1" if strict else "")
    return f"""{name} AS (
    SELECT entity, n, s + 1 AS split,
           CAST(CASE WHEN k = 1 THEN last ELSE 15 + round_even(s * (CAST(last - 15 AS DOUBLE) / (k - 1)), 0) END AS INTEGER) AS cutoff
    FROM (SELECT *, unnest(range(0, k)) AS s FROM (
        SELECT entity, n, {last} AS last, least({splits}, {last} - 15) AS k
        FROM (SELECT entity, count(*) AS n FROM {panel} GROUP BY entity)) WHERE k > 0))"""


def cutoffs_sql(panel: str, horizon: int, splits: int) -> str:
    return f"""SELECT entity, n AS n_dates, 'ok' AS status, split, cutoff FROM cutoffs
        UNION ALL SELECT entity, count(*), 'not_enough_dates', 0, -1 FROM {panel} GROUP BY entity HAVING count(*) - {horizon} <= 15"""


@query("backtest_cutoffs", with_(SALES, cutoffs_cte("sales", 7, 5), cutoffs_sql("sales", 7, 5)))
def backtest_cutoffs(spark, sf_dir):
    return B.backtest_cutoffs(_sales(spark, sf_dir), 7, 5)


@query("backtest_cutoffs_short", with_(USER_DAYS, cutoffs_cte("user_days", 7, 20), cutoffs_sql("user_days", 7, 20)))
def backtest_cutoffs_short(spark, sf_dir):
    return B.backtest_cutoffs(_user_days(spark, sf_dir), 7, 20)


def backtest_ctes(panel: str, horizon: int, splits: int, strict: bool = False) -> tuple[str, ...]:
    return (
        cutoffs_cte(panel, horizon, splits, strict),
        f"placed AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS rn FROM {panel})",
        f"""scored AS (
            SELECT c.entity, c.split, h.date AS cutoff_date, a.target AS y_true, b.target AS y_pred
            FROM cutoffs c JOIN placed h ON h.entity = c.entity AND h.rn = c.cutoff
            JOIN placed a ON a.entity = c.entity AND a.rn > c.cutoff AND a.rn <= c.cutoff + {horizon} AND a.date - h.date <= {horizon}
            JOIN placed b ON b.entity = c.entity AND b.rn = c.cutoff - 6 + (a.date - h.date - 1) % 7)""",
        f"""splits AS (
            SELECT entity, split, cutoff_date, count(*) AS horizon, CAST(format('{{:.4f}}', {RMSE_SQL}) AS DOUBLE) AS rmse, CAST(format('{{:.4f}}', {MAE_SQL}) AS DOUBLE) AS mae,
                   CAST(format('{{:.2f}}', avg(CASE WHEN y_true <> 0 THEN abs((y_true - y_pred) / y_true) END) * 100) AS DOUBLE) AS mape
            FROM scored GROUP BY ALL)""",
    )


SHOW_SPLITS = "SELECT entity, split, CAST(cutoff_date AS VARCHAR) AS cutoff_date, horizon, rmse, mae, mape FROM splits"
SALES_SPLITS = (SALES, *backtest_ctes("sales", 7, 5))


def sales_splits(spark, sf_dir):
    return B.backtest_naive(_sales(spark, sf_dir), 7, 5)


@query("backtest", with_(*SALES_SPLITS, SHOW_SPLITS))
def backtest(spark, sf_dir):
    return sales_splits(spark, sf_dir)


@query("backtest_strict", with_(SEGMENTS, *backtest_ctes("segments", 1, 20, strict=True), SHOW_SPLITS))
def backtest_strict(spark, sf_dir):
    return B.backtest_naive(_segments(spark, sf_dir), 1, 20, strict=True)


AVERAGES = """averages AS (
    SELECT entity, n AS n_splits, ((2 * a + n) // (2 * n)) / 10000.0 AS rmse, ((2 * b + n) // (2 * n)) / 10000.0 AS mae,
           ((2 * c + nc) // (2 * nc)) / 100.0 AS mape
    FROM (SELECT entity, count(*) AS n, count(mape) AS nc, CAST(sum(CAST(round(rmse * 10000) AS BIGINT)) AS BIGINT) AS a,
                 CAST(sum(CAST(round(mae * 10000) AS BIGINT)) AS BIGINT) AS b, CAST(sum(CAST(round(mape * 100) AS BIGINT)) AS BIGINT) AS c
          FROM splits GROUP BY entity))"""


@query("backtest_average", with_(*SALES_SPLITS, AVERAGES, "SELECT * FROM averages"))
def backtest_average(spark, sf_dir):
    return B.backtest_average(sales_splits(spark, sf_dir))


@query(
    "backtest_error_series",
    with_(
        *SALES_SPLITS,
        """SELECT s.entity, CAST(cutoff_date AS VARCHAR) AS cutoff_date, m.metric, CASE m.metric WHEN 'mae' THEN mae ELSE mape END AS value,
                  CAST(sum(horizon) OVER (PARTITION BY s.entity, m.metric) AS BIGINT) AS total_samples
           FROM splits s, (SELECT unnest(['mae', 'mape']) AS metric) m""",
    ),
)
def backtest_error_series(spark, sf_dir):
    return E.backtest_error_series(sales_splits(spark, sf_dir))


# ---- reports ---------------------------------------------------------------------------------------


@query(
    "historical_metrics",
    with_(
        SALES, cutoff_cte("sales"), TRAIN, naive_cte("train", 60),
        "wanted AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)",
        """a AS (SELECT * FROM sales WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-12-31' AND entity IN (SELECT s_suppkey FROM wanted))""",
        """f AS (SELECT * FROM naive WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-12-31' AND entity_id IN (SELECT s_suppkey FROM wanted))""",
        """SELECT coalesce(a.entity, f.entity_id) AS series_id, CAST(coalesce(a.date, f.date) AS VARCHAR) AS date, target AS actual, y_pred AS forecast,
                  target - y_pred AS error, 'v1' AS model_version FROM a FULL JOIN f ON a.entity = f.entity_id AND a.date = f.date""",
    ),
)
def historical_metrics(spark, sf_dir):
    train, _ = FC.time_split(_sales(spark, sf_dir))
    wanted = panels.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("entity"))
    return E.historical_metrics(
        FC.seasonal_naive(train, 60), _sales(spark, sf_dir), "2000-06-01", "2000-12-31", wanted=wanted
    )


@query(
    "metric_series",
    with_(
        *PAIRS,
        f"""SELECT 'daily' AS granularity, 'mae' AS metric, CAST(date AS VARCHAR) AS date, round({MAE_SQL}, 6) AS value FROM pairs GROUP BY date
            UNION ALL SELECT 'weekly', 'mape', CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR), round({MAPE_SQL}, 6) FROM pairs GROUP BY date_trunc('week', date)""",
    ),
)
def metric_series(spark, sf_dir):
    pairs = sales_pairs(spark, sf_dir)
    daily = E.metric_series(pairs, "mae").select(F.lit("daily").alias("granularity"), F.lit("mae").alias("metric"), "date", "value")
    weekly = E.metric_series(pairs, "mape", "weekly").select(F.lit("weekly").alias("granularity"), F.lit("mape").alias("metric"), "date", "value")
    return daily.unionByName(weekly)


@query(
    "forecast_vs_actual",
    with_(
        SALES, cutoff_cte("sales"), TRAIN, naive_cte("train", 60, 7, "weekly"), naive_cte("train", 60, 14, "fortnightly"),
        """SELECT w.entity_id, CAST(w.date AS VARCHAR) AS date, w.y_pred AS forecast, s.target AS actual, b.y_pred AS baseline
           FROM weekly w LEFT JOIN sales s ON s.entity = w.entity_id AND s.date = w.date
           LEFT JOIN fortnightly b ON b.entity_id = w.entity_id AND b.date = w.date""",
    ),
)
def forecast_vs_actual(spark, sf_dir):
    train, _ = FC.time_split(_sales(spark, sf_dir))
    return E.forecast_vs_actual(FC.seasonal_naive(train, 60), _sales(spark, sf_dir), FC.seasonal_naive(train, 60, 14))


@query(
    "promotion_gate",
    with_(
        *PAIRS, BY_ENTITY,
        """SELECT entity, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, mae <= 17 AS mae_ok, rmse <= 22 AS rmse_ok,
                  mape <= 180 AS mape_ok, mae <= 17 AND rmse <= 22 AND mape <= 180 AS promote FROM by_entity""",
    ),
)
def promotion_gate(spark, sf_dir):
    limits = PromotionConfig(mae_max=17.0, rmse_max=22.0, mape_max=180.0)
    return E.promotion_gate(E.metrics_by_entity(sales_pairs(spark, sf_dir)), limits)
