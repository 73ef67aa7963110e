"""Registered queries: features, splits, models, forecasts, run records."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsspark.config import FeatureConfig, Settings, TreeConfig
from tsspark.operators import features as FE
from tsspark.operators import forecast as FC
from tsspark.operators import registry as R
from tsspark.operators import trees as TR
from tsspark.operators.evaluate import align, metrics_entity_mean
from tsspark.plans import training
from tsspark.plans.catalog import (
    MAE_SQL, MAPE_SQL, RMSE_SQL, SALES, SEGMENTS, cutoff_cte, naive_cte, pairs_cte, query, with_,
)
from tsspark.session import scratch_path
from tsspark.sources import files, panels

CONFIG = FeatureConfig()
HORIZON = 14


def features_cte(panel: str, name: str = "featured") -> str:
    lags = ", ".join(f"lag(target, {k}) OVER w AS lag_{k}" for k in CONFIG.lags)
    rolling = ", ".join(
        f"avg(target) OVER w{w} AS rolling_mean_{w}, stddev_samp(target) OVER w{w} AS rolling_std_{w}" for w in CONFIG.windows
    )
    frames = ", ".join(f"w{w} AS (PARTITION BY entity ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in CONFIG.windows)
    return f"""{name} AS (
    SELECT *, {lags}, {rolling}, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, weekofyear(date) AS week_of_year,
           month(date) AS month, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend
    FROM {panel} WINDOW w AS (PARTITION BY entity ORDER BY date), {frames})"""


KEYS = "entity, CAST(date AS VARCHAR) AS date"
LAGS = ", ".join(f"lag_{k}" for k in CONFIG.lags)
MEANS = ", ".join(f"round(rolling_mean_{w}, 6) AS rolling_mean_{w}" for w in CONFIG.windows)
STDS = ", ".join(f"round(rolling_std_{w}, 6) AS rolling_std_{w}" for w in CONFIG.windows)
CALENDAR = "day_of_week, day_of_month, week_of_year, month, is_weekend"
ALL_FEATURES = f"{LAGS}, {MEANS}, {STDS}, {CALENDAR}"


def _sales(spark, sf_dir):
    return panels.sales_daily(spark, sf_dir)


@contextmanager
def _kept_sales(spark, sf_dir) -> Iterator[DataFrame]:
    """Daily sales for the jobs of one query: added up and laid out by series once, kept on disk, released at the end.

    What is made from it must be computed inside; a forecast is, up to its last cut of the lineage.
    """
    sales = _sales(spark, sf_dir).repartition("entity").sortWithinPartitions("entity", "date").persist(StorageLevel.DISK_ONLY)
    try:
        yield sales
    finally:
        sales.unpersist()


def _segments(spark, sf_dir):
    return panels.segment_daily(spark, sf_dir)


# ---- features --------------------------------------------------------------------------------------


@query("lag_features", with_(SALES, features_cte("sales"), f"SELECT {KEYS}, target, {LAGS} FROM featured"))
def lag_features(spark, sf_dir):
    return FE.LagFeatures(lags=[14, 7, 1, 7, -3]).transform(_sales(spark, sf_dir))


@query("rolling_mean", with_(SALES, features_cte("sales"), f"SELECT {KEYS}, target, {MEANS} FROM featured"))
def rolling_mean(spark, sf_dir):
    rolled = FE.RollingFeatures(windows=[7, 14]).transform(_sales(spark, sf_dir))
    return rolled.drop("rolling_std_7", "rolling_std_14")


@query("rolling_std", with_(SALES, features_cte("sales"), f"SELECT {KEYS}, target, {STDS} FROM featured"))
def rolling_std(spark, sf_dir):
    rolled = FE.RollingFeatures(windows=[7, 14]).transform(_sales(spark, sf_dir))
    return rolled.drop("rolling_mean_7", "rolling_mean_14")


@query("calendar_features", with_(SALES, features_cte("sales"), f"SELECT {KEYS}, target, {CALENDAR} FROM featured"))
def calendar_features(spark, sf_dir):
    return FE.CalendarFeatures(date="date").transform(_sales(spark, sf_dir))


@query("features", with_(SALES, features_cte("sales"), f"SELECT {KEYS}, target, {ALL_FEATURES} FROM featured"))
def features(spark, sf_dir):
    return FE.add_features(_sales(spark, sf_dir))


@query("select_feature_columns", with_(SEGMENTS, features_cte("segments"), f"SELECT {KEYS}, {ALL_FEATURES} FROM featured"))
def select_feature_columns(spark, sf_dir):
    table = FE.add_features(_segments(spark, sf_dir)).withColumn("target_raw", F.col("target"))
    return table.select("entity", "date", *FE.feature_names(table.columns))


@query("enforce_feature_columns", with_(SEGMENTS, features_cte("segments"), f"SELECT {KEYS}, month, lag_7, lag_1 FROM featured"))
def enforce_feature_columns(spark, sf_dir):
    return FE.enforce_features(FE.add_features(_segments(spark, sf_dir)), ["month", "lag_7", "lag_1"], keep=["entity", "date"])


@query(
    "warmup_filter",
    with_(SALES, features_cte("sales"), f"""SELECT {KEYS}, target, {ALL_FEATURES} FROM featured
          WHERE target IS NOT NULL AND lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL AND rolling_std_7 IS NOT NULL"""),
)
def warmup_filter(spark, sf_dir):
    table = FE.add_features(_sales(spark, sf_dir))
    return FE.drop_warmup(table, FE.feature_names(table.columns))


@query("base_columns", with_(SEGMENTS, f"SELECT {KEYS}, target FROM segments"))
def base_columns(spark, sf_dir):
    return FE.base_columns(FE.add_features(_segments(spark, sf_dir)))


# ---- splits and the naive model --------------------------------------------------------------------


@query(
    "time_split",
    with_(SALES, cutoff_cte("sales"), f"SELECT {KEYS}, target, CASE WHEN date >= cutoff THEN 'validation' ELSE 'train' END AS split FROM sales, cut"),
)
def time_split(spark, sf_dir):
    train, held_out = FC.time_split(_sales(spark, sf_dir))
    return train.withColumn("split", F.lit("train")).unionByName(held_out.withColumn("split", F.lit("validation")))


NAIVE_KEYS = "entity_id, CAST(date AS VARCHAR) AS date, y_pred, model_name, step"


@query("seasonal_naive_forecast", with_(SALES, naive_cte("sales", HORIZON), f"SELECT {NAIVE_KEYS} FROM naive"))
def seasonal_naive_forecast(spark, sf_dir):
    return FC.seasonal_naive(_sales(spark, sf_dir), HORIZON)


# the residuals of the naive forecasts on both sides of the split date
def _split_pairs(sales):
    pairs = panels.forecast_pairs(sales)
    cutoff = FC.split_date(sales, 0.2)
    return pairs.where(F.col("date") >= cutoff), pairs.where(F.col("date") < cutoff)


SPREAD = "spread AS (SELECT round_even(stddev_pop(y_true - y_pred), 4) AS residual_std FROM pairs, cut WHERE date >= cutoff)"
SPREAD_CTES = (SALES, cutoff_cte("sales"), pairs_cte("sales"), SPREAD)


@query("residual_std", with_(*SPREAD_CTES, "SELECT round(residual_std, 6) AS residual_std, 'validation' AS source FROM spread"))
def residual_std(spark, sf_dir):
    return FC.residual_std(*_split_pairs(_sales(spark, sf_dir)))


def _naive_with_bounds(spark, sf_dir):
    spread = FC.residual_std(*_split_pairs(_sales(spark, sf_dir))).select("residual_std").scalar()
    return FC.with_interval(FC.seasonal_naive(_sales(spark, sf_dir), HORIZON), spread)


BOUNDS = """CASE WHEN residual_std > 0 THEN CAST(format('{:.2f}', y_pred - 1.96 * residual_std) AS DOUBLE) END AS confidence_low,
            CASE WHEN residual_std > 0 THEN CAST(format('{:.2f}', y_pred + 1.96 * residual_std) AS DOUBLE) END AS confidence_high"""


@query("prediction_interval", with_(*SPREAD_CTES, naive_cte("sales", HORIZON), f"SELECT {NAIVE_KEYS}, {BOUNDS} FROM naive, spread"))
def prediction_interval(spark, sf_dir):
    return _naive_with_bounds(spark, sf_dir)


@query(
    "forecast_arrays",
    with_(*SPREAD_CTES, naive_cte("sales", HORIZON),
          f"""SELECT entity_id AS series_id, 'v1' AS model_version, 'D' AS frequency, 0.95 AS interval_level, step AS steps,
                     y_pred AS point_forecast, confidence_low AS lower, confidence_high AS upper
              FROM (SELECT *, {BOUNDS} FROM naive, spread)"""),
)
def forecast_arrays(spark, sf_dir):
    arrays = FC.forecast_arrays(_naive_with_bounds(spark, sf_dir))
    unrolled = F.inline(F.arrays_zip("steps", "point_forecast", "lower", "upper"))
    return arrays.select("series_id", "model_version", "frequency", "interval_level", unrolled)


def _user_days(spark, sf_dir):
    """Event days per user; short series."""
    events = panels.table(spark, sf_dir, "events")
    keys = [F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("date")]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("target"))


USER_DAYS = """user_days AS (
    SELECT user_id AS entity, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS target FROM events GROUP BY 1, 2)"""


@query(
    "history_guard",
    with_(USER_DAYS, """SELECT entity, count(*) AS n_rows, 28 AS required,
          CASE WHEN count(*) < 28 THEN 'insufficient_history' ELSE 'ok' END AS status FROM user_days GROUP BY entity"""),
)
def history_guard(spark, sf_dir):
    return FC.history_guard(_user_days(spark, sf_dir), max_lag=28)


@query("short_series", with_(USER_DAYS, "SELECT entity, count(*) AS n_rows FROM user_days GROUP BY entity HAVING count(*) < 27"))
def short_series(spark, sf_dir):
    return FC.short_series(_user_days(spark, sf_dir), 27)


@query(
    "known_entity_filter",
    with_(SALES, "SELECT c_custkey AS entity, c_custkey IN (SELECT entity FROM sales) AS known FROM customer"),
)
def known_entity_filter(spark, sf_dir):
    requested = panels.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    return FC.known_entities(requested, _sales(spark, sf_dir))


@query("last_observed_date", with_(SALES, "SELECT entity, CAST(max(date) AS VARCHAR) AS last_date FROM sales GROUP BY entity"))
def last_observed_date(spark, sf_dir):
    return FC.last_observed_date(_sales(spark, sf_dir))


# ---- run records -----------------------------------------------------------------------------------


def _naive_record(spark, sf_dir, registry=None, sales=None):
    """The record of a naive run: its model has no trees, so SQL can follow every field."""
    panel = _sales(spark, sf_dir) if sales is None else sales
    table = FE.add_features(panel)
    train, held_out = FC.time_split(table)
    made = FC.seasonal_naive(train, 30)
    return R.run_record(
        train,
        FE.feature_names(table.columns),
        metrics_entity_mean(align(made, held_out)),
        FC.residual_std(*_split_pairs(panel)),
        hyperparameters={"seasonality": 7},
        registry=registry,
        trained_at=F.lit("2024-01-01T00:00:00Z"),
    )


RECORD_CTES = (
    *SPREAD_CTES,
    features_cte("sales"),
    "train AS (SELECT featured.* FROM featured, cut WHERE date < cutoff)",
    naive_cte("train", 30),
    "aligned AS (SELECT s.entity, s.target AS y_true, y_pred FROM naive JOIN sales s ON s.entity = entity_id AND s.date = naive.date JOIN cut ON s.date >= cutoff)",
    f"by_entity AS (SELECT entity, {MAE_SQL} AS mae, {RMSE_SQL} AS rmse, {MAPE_SQL} AS mape FROM aligned GROUP BY entity)",
    "scores AS (SELECT round_even(avg(mae), 4) AS mae, round_even(avg(rmse), 4) AS rmse, round_even(avg(mape), 2) AS mape FROM by_entity)",
)
FEATURE_LIST = ["lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_std_7", "rolling_mean_14", "rolling_std_14", *FE.CALENDAR_COLUMNS]


@query(
    "run_registry",
    with_(
        *RECORD_CTES,
        f"""SELECT 'v1' AS model_version, '2024-01-01T00:00:00Z' AS trained_at,
                   (SELECT CAST(min(date) AS VARCHAR) FROM train) AS train_start, (SELECT CAST(max(date) AS VARCHAR) FROM train) AS train_end,
                   '{','.join(FEATURE_LIST)}' AS feature_columns, {len(FEATURE_LIST)} AS feature_count,
                   (SELECT count(*) FROM train WHERE target IS NOT NULL AND lag_14 IS NOT NULL AND rolling_std_7 IS NOT NULL) AS sample_size,
                   '7' AS seasonality, residual_std, mae, rmse, mape, 14 AS max_lag, 14 AS lookback_window
            FROM scores, spread""",
    ),
)
def run_registry(spark, sf_dir):
    record = _naive_record(spark, sf_dir)
    return record.select(
        "model_version", "trained_at", F.col("training_date_range.start").alias("train_start"),
        F.col("training_date_range.end").alias("train_end"), F.array_join("feature_columns", ",").alias("feature_columns"),
        "feature_count", "sample_size", F.col("hyperparameters")["seasonality"].alias("seasonality"), "residual_std",
        "validation_metrics.mae", "validation_metrics.rmse", "validation_metrics.mape", "max_lag", "lookback_window",
    )


@query(
    "registry_check",
    with_(
        SALES,
        """SELECT model_version, sample_size, round(residual_std, 6) AS residual_std,
                  concat_ws('; ', CASE WHEN residual_std IS NULL THEN 'residual_std missing' END,
                            CASE WHEN max_lag < 0 THEN 'max_lag negative' END) AS problems,
                  residual_std IS NOT NULL AND max_lag >= 0 AS valid
           FROM (SELECT concat('v', entity, '-', month(date) + 12 * year(date)) AS model_version, count(*) AS sample_size,
                        stddev_samp(target) AS residual_std, CAST(count(*) AS BIGINT) - 2 AS max_lag
                 FROM sales GROUP BY entity, year(date), month(date))""",
    ),
)
def registry_check(spark, sf_dir):
    """Run records of every entity and month; those of a single day have no residual spread."""
    month = F.month("date") + 12 * F.year("date")
    runs = _sales(spark, sf_dir).groupBy("entity", month.alias("month")).agg(
        F.count(F.lit(1)).alias("sample_size"), F.stddev_samp("target").alias("residual_std"),
        F.min("date").cast("string").alias("start"), F.max("date").cast("string").alias("end"),
    )
    registry = runs.select(
        F.concat(F.lit("v"), "entity", F.lit("-"), "month").alias("model_version"),
        F.col("end").alias("trained_at"),
        F.struct("start", "end").alias("training_date_range"),
        F.array(F.lit("lag_1")).alias("feature_columns"),
        F.lit(1).alias("feature_count"),
        "sample_size",
        F.create_map(F.lit("seasonality"), F.lit("7")).alias("hyperparameters"),
        "residual_std",
        F.struct("residual_std").alias("validation_metrics"),
        (F.col("sample_size") - 2).alias("max_lag"),
        F.col("sample_size").alias("lookback_window"),
    )
    checked = R.registry_check(registry)
    return checked.select("model_version", "sample_size", "residual_std", F.array_join("problems", "; ").alias("problems"), "valid")


# ---- the tree model --------------------------------------------------------------------------------

SETTINGS = Settings()
_FITTED: dict[tuple[str, str], tuple] = {}


def tree_panel(spark, sf_dir, sales=None):
    """Daily sales with the supplier's nation as a category."""
    kinds = panels.store_master(spark, sf_dir).select(F.col("Store").alias("entity"), F.col("StoreType").alias("store_type"))
    return (_sales(spark, sf_dir) if sales is None else sales).join(kinds, "entity", "left")


def fitted(spark, sf_dir, panel=None):
    """The model of this session's tables; several queries share one fit. ``panel`` is the tree panel where a query keeps it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        panel = tree_panel(spark, sf_dir) if panel is None else panel
        _FITTED[key] = training.fit_on_history(panel, SETTINGS, categorical=["store_type"])
    return _FITTED[key]


@query("fit_gbt")
def fit_gbt(spark, sf_dir):
    """Predictions of the fitted model on the validation rows."""
    model, names = fitted(spark, sf_dir)
    _, held_out = FC.time_split(training.featured_panel(tree_panel(spark, sf_dir)))
    scored = model.transform(FE.drop_warmup(held_out, names))
    return scored.select("entity", "date", F.col("target").alias("y_true"), F.col("prediction").alias("y_pred"))


@query("recursive_forecast")
def recursive_forecast(spark, sf_dir):
    with _kept_sales(spark, sf_dir) as sales:
        panel = tree_panel(spark, sf_dir, sales)
        model, _ = fitted(spark, sf_dir, panel)
        return TR.recursive_forecast(panel, model, HORIZON)


@query(
    "category_alignment",
    with_(
        SALES, cutoff_cte("sales"),
        """SELECT entity, CASE WHEN c_mktsegment IN ('BUILDING') THEN n_name ELSE c_mktsegment END AS store_type,
                  n_known, CASE WHEN c_mktsegment IN ('BUILDING') THEN level ELSE n_known END AS level
           FROM (SELECT s_suppkey AS entity, n_name, c_mktsegment FROM supplier JOIN nation ON s_nationkey = n_nationkey
                 JOIN customer ON c_custkey = s_suppkey)
           JOIN (SELECT n_name AS known_name, dense_rank() OVER (ORDER BY n_name) - 1 AS level, count(*) OVER () AS n_known
                 FROM (SELECT DISTINCT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
                       WHERE s_suppkey IN (SELECT entity FROM sales, cut WHERE date < cutoff))) ON known_name = n_name""",
    ),
)
def category_alignment(spark, sf_dir):
    """Trained levels keep their number; a value unseen in training gets the one after the last."""
    model, _ = fitted(spark, sf_dir)
    indexer = model.stages[0]
    segments = panels.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    kinds = panels.store_master(spark, sf_dir).select(F.col("Store").alias("entity"), "StoreType").join(segments, "entity")
    known = F.col("c_mktsegment") == "BUILDING"
    asked = kinds.select("entity", F.when(known, F.col("StoreType")).otherwise(F.col("c_mktsegment")).alias("store_type"))
    aligned = indexer.transform(asked)
    return aligned.select(
        "entity", "store_type", F.lit(len(indexer.labels)).alias("n_known"), F.col(indexer.getOutputCol()).cast("int").alias("level")
    )


@query("feature_importance_topk")
def feature_importance_topk(spark, sf_dir):
    model, _ = fitted(spark, sf_dir)
    return TR.feature_importance(spark, model)


@query("batch_forecast")
def batch_forecast(spark, sf_dir):
    with _kept_sales(spark, sf_dir) as sales:
        panel = tree_panel(spark, sf_dir, sales)
        model, _ = fitted(spark, sf_dir, panel)
        spread = FC.residual_std(*_split_pairs(sales)).first()["residual_std"]
        return training.batch_forecast(panel, model, SETTINGS, spread)


@query("train_and_compare")
def train_and_compare(spark, sf_dir):
    run = training.train_and_compare(panels.events_daily(spark, sf_dir), SETTINGS)
    return run.comparison


@query("save_and_load_model")
def save_and_load_model(spark, sf_dir):
    """Forecasts of the model after a round trip through storage, with the loaded record's version."""
    with _kept_sales(spark, sf_dir) as sales:
        panel = tree_panel(spark, sf_dir, sales)
        model, _ = fitted(spark, sf_dir, panel)
        path = scratch_path(spark, "model")
        files.save_model(model, _naive_record(spark, sf_dir, sales=sales), path)
        loaded, record = files.load_model(spark, path, R.REGISTRY_SCHEMA)
        made = TR.recursive_forecast(panel, loaded, 7)
        return made.withColumn("model_version", record.select("model_version").scalar())


@query("backtest_gbt")
def backtest_gbt(spark, sf_dir):
    model, _ = fitted(spark, sf_dir)
    return TR.backtest_trees(tree_panel(spark, sf_dir), model, 7, 3)


# ---- the same roll forward under a fixed linear model, which SQL can follow ------------------------

LINEAR = "0.5 * lag_1 + 0.3 * lag_7 + 0.2 * rolling_mean_7"


def linear_model() -> PipelineModel:
    assembler = VectorAssembler(inputCols=["lag_1", "lag_7", "rolling_mean_7"], outputCol="features")
    return PipelineModel([assembler, SQLTransformer(statement=f"SELECT *, {LINEAR} AS prediction FROM __THIS__")])


def roll_cte(horizon: int) -> str:
    return f"""roll AS (
    SELECT entity, max(date) AS last_date, list(target ORDER BY date) AS hist, 0 AS step FROM sales GROUP BY entity
    UNION ALL
    SELECT entity, last_date, list_append(hist, 0.5 * hist[-1] + 0.3 * hist[-7] + 0.2 * list_avg(hist[-7:])), step + 1
    FROM (SELECT entity, last_date, hist[-30:] AS hist, step FROM roll) WHERE step < {horizon})"""


ROLLED = """SELECT entity AS entity_id, CAST(last_date + step AS VARCHAR) AS date, round(hist[-1], 6) AS y_pred, step{more} FROM roll{join} WHERE step > 0"""


@query("recursive_forecast_linear", "WITH RECURSIVE " + with_(SALES, roll_cte(HORIZON), ROLLED.format(more="", join="")).removeprefix("WITH "))
def recursive_forecast_linear(spark, sf_dir):
    return TR.recursive_forecast(_sales(spark, sf_dir), linear_model(), HORIZON).drop("model_name")


@query(
    "batch_forecast_linear",
    "WITH RECURSIVE " + with_(
        SALES, roll_cte(30),
        ROLLED.format(more=", CAST(format('{:.2f}', hist[-1] - 1.96 * 12.5) AS DOUBLE) + 0.0 AS confidence_low, CAST(format('{:.2f}', hist[-1] + 1.96 * 12.5) AS DOUBLE) + 0.0 AS confidence_high", join=""),
    ).removeprefix("WITH "),
)
def batch_forecast_linear(spark, sf_dir):
    return training.batch_forecast(_sales(spark, sf_dir), linear_model(), SETTINGS, 12.5).drop("model_name")


@query("model_round_trip", with_(SALES, "SELECT count(DISTINCT entity) * 7 AS n_forecasts, CAST(0 AS BIGINT) AS n_different FROM sales"))
def model_round_trip(spark, sf_dir):
    """Forecasts that differ after the fitted model went through storage: none."""
    with _kept_sales(spark, sf_dir) as sales:
        panel = tree_panel(spark, sf_dir, sales)
        model, _ = fitted(spark, sf_dir, panel)
        path = scratch_path(spark, "model")
        files.save_model(model, _naive_record(spark, sf_dir, sales=sales), path)
        loaded, _ = files.load_model(spark, path, R.REGISTRY_SCHEMA)
        keys = ["entity_id", "date", "step"]
        before = TR.recursive_forecast(panel, model, 7).select(*keys, F.col("y_pred").alias("before"))
        after = TR.recursive_forecast(panel, loaded, 7).select(*keys, F.col("y_pred").alias("after"))
    both = before.join(after, keys, "full")
    return both.agg(F.count(F.lit(1)).alias("n_forecasts"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_different"))


# ---- what SQL can follow of the fit and the comparison -----------------------------------------------

STUMP = ("day_of_week", "day_of_month", "month")
STUMP_CTES = (
    SALES, features_cte("sales"), cutoff_cte("sales"),
    "train AS (SELECT featured.* FROM featured, cut WHERE date < cutoff)",
    "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {k} AS place, {f} AS value, target FROM train" for k, f in enumerate(STUMP)) + ")",
    "per_value AS (SELECT feature, place, value, count(*) AS n, sum(target) AS s, sum(target * target) AS q FROM long GROUP BY 1, 2, 3)",
    """sides AS (SELECT feature, place, value, sum(n) OVER upto AS n, sum(s) OVER upto AS s, sum(q) OVER upto AS q,
                        sum(n) OVER everything AS n_all, sum(s) OVER everything AS s_all, sum(q) OVER everything AS q_all
                 FROM per_value WINDOW upto AS (PARTITION BY feature ORDER BY value), everything AS (PARTITION BY feature))""",
    """best AS (SELECT feature, value, s / n AS below, (s_all - s) / (n_all - n) AS above FROM sides WHERE n < n_all
                ORDER BY s * s / n + (s_all - s) * (s_all - s) / (n_all - n) DESC, place, value LIMIT 1)""",
)


def stump(spark, sf_dir):
    """One tree of one split over calendar fields; the split with the least squared error."""
    train, held_out = FC.time_split(FE.add_features(_sales(spark, sf_dir)))
    return TR.fit_trees(train, STUMP, config=TreeConfig(n_trees=1, max_depth=1)), held_out


@query(
    "fit_stump",
    with_(*STUMP_CTES, f"""SELECT {KEYS}, target AS y_true, round(
          CASE WHEN CASE best.feature {' '.join(f"WHEN '{f}' THEN {f}" for f in STUMP)} END <= best.value THEN below ELSE above END, 6) AS y_pred
          FROM featured, cut, best WHERE date >= cutoff"""),
)
def fit_stump(spark, sf_dir):
    model, held_out = stump(spark, sf_dir)
    return model.transform(held_out).select("entity", "date", F.col("target").alias("y_true"), F.col("prediction").alias("y_pred"))


@query(
    "stump_importance",
    with_(*STUMP_CTES, "SELECT f.feature, CASE WHEN f.feature = best.feature THEN 1.0 ELSE 0.0 END AS importance FROM (SELECT DISTINCT feature FROM long) f, best"),
)
def stump_importance(spark, sf_dir):
    return TR.feature_importance(spark, stump(spark, sf_dir)[0])


SHORT_SHARE = 0.02
BOTH_SCORES = " UNION ALL ".join(
    f"""SELECT '{role}' AS role, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, (SELECT count(*) FROM met) AS n_pairs
        FROM (SELECT entity, {MAE_SQL} AS mae, {RMSE_SQL} AS rmse, {MAPE_SQL} AS mape FROM (SELECT entity, y_true, {column} AS y_pred FROM met) GROUP BY entity)"""
    for role, column in (("baseline", "base_pred"), ("primary", "main_pred"))
)


@query(
    "train_and_compare_linear",
    "WITH RECURSIVE " + with_(
        SALES, cutoff_cte("sales", 1 - SHORT_SHARE),
        "train AS (SELECT sales.* FROM sales, cut WHERE date < cutoff)",
        "held_out AS (SELECT sales.* FROM sales, cut WHERE date >= cutoff)",
        "span AS (SELECT count(DISTINCT date) AS hz FROM held_out)",
        naive_cte("train", 400),
        roll_cte(0).replace("FROM sales", "FROM train").replace("step < 0", "step < (SELECT hz FROM span)"),
        """met AS (SELECT h.entity, h.target AS y_true, f.y_pred AS base_pred, r.hist[-1] AS main_pred
                   FROM held_out h JOIN naive f ON f.entity_id = h.entity AND f.date = h.date JOIN span ON f.step <= hz
                   JOIN roll r ON r.entity = h.entity AND CAST(r.last_date + r.step AS DATE) = h.date AND r.step > 0)""",
        f"SELECT role, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, n_pairs FROM ({BOTH_SCORES})",
    ).removeprefix("WITH "),
)
def train_and_compare_linear(spark, sf_dir):
    """The whole comparison with a fixed linear model in place of the trees: both models on the points both forecast."""
    settings = replace(SETTINGS, validation_share=SHORT_SHARE)
    return training.train_and_compare(_sales(spark, sf_dir), settings, fit=lambda train, features: linear_model()).comparison
