import math

import pytest
from pyspark.sql import functions as F

from tsspark.config import FeatureConfig, ForecastConfig, Settings, TreeConfig, overlay, percent
from tsspark.operators import features as FE
from tsspark.operators import forecast as FC
from tsspark.operators import trees as TR
from tsspark.plans import training

PANEL = "date date, entity string, target double"
SMALL = TreeConfig(n_trees=4, max_depth=3)


@pytest.fixture
def two(frame, days):
    d = days("2024-01-01", 7)
    return frame([(x, "A", float(i + 1)) for i, x in enumerate(d)] + [(x, "B", 10.0 * (i + 1)) for i, x in enumerate(d)], PANEL)


@pytest.fixture(scope="module")
def panel(spark):
    rows = spark.range(4).select(F.concat(F.lit("s"), "id").alias("entity"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"))
    return rows.select(
        "entity", F.date_add(F.lit("2024-01-01").cast("date"), "i").alias("date"),
        (F.lit(50) + 10 * F.sin(F.col("i")) + F.col("i") % 7 * 3).alias("target"), F.substring("entity", 2, 1).alias("kind"),
    )


@pytest.fixture(scope="module")
def model(panel):
    table = FE.add_features(panel)
    return TR.fit_trees(table, FE.feature_names(table.columns), config=SMALL)


def test_naive_repeats_the_season(two):
    out = FC.seasonal_naive(two, 9).orderBy("entity_id", "step").collect()
    assert [r["y_pred"] for r in out if r["entity_id"] == "A"] == [1, 2, 3, 4, 5, 6, 7, 1, 2]
    assert [r["y_pred"] for r in out if r["entity_id"] == "B"][:3] == [10, 20, 30]
    assert str(out[0]["date"]) == "2024-01-08" and out[0]["model_name"] == "seasonal_naive"


def test_naive_skips_and_reports_short_series(two):
    short = two.where("entity = 'A' or date > '2024-01-05'")
    assert {r["entity_id"] for r in FC.seasonal_naive(short, 2).collect()} == {"A"}
    assert [(r["entity"], r["n_rows"]) for r in FC.short_series(short, 7).collect()] == [("B", 2)]


def test_naive_refuses_bad_bounds(two):
    with pytest.raises(ValueError):
        FC.seasonal_naive(two, 0)
    with pytest.raises(ValueError):
        FC.check_bounds(61)
    with pytest.raises(ValueError):
        FC.check_bounds(7, 21)


@pytest.mark.parametrize("share, n_train", [(0.2, 5), (0.5, 3), (0.0, 7), (1.0, 7)])
def test_split_by_distinct_dates(two, share, n_train):
    train, held_out = FC.time_split(two, share)
    assert train.count() == 2 * n_train and held_out.count() == 2 * (7 - n_train)


def test_split_of_one_date_is_all_training(two):
    train, held_out = FC.time_split(two.where("date = '2024-01-01'"))
    assert (train.count(), held_out.count()) == (2, 0)


def test_interval_is_symmetric(spark):
    row = FC.with_interval(spark.createDataFrame([(1000.0,)], "y_pred double"), 100.0).first()
    assert (row["confidence_low"], row["confidence_high"]) == (804.0, 1196.0)


@pytest.mark.parametrize("spread", [0.0, None, -1.0])
def test_no_interval_without_spread(spark, spread):
    row = FC.with_interval(spark.createDataFrame([(1000.0,)], "y_pred double"), spread).first()
    assert row["confidence_low"] is None and row["confidence_high"] is None


def test_residual_std_prefers_validation(spark):
    held = spark.createDataFrame([(1.0, 0.0), (3.0, 0.0)], "y_true double, y_pred double")
    fitted = spark.createDataFrame([(0.0, 0.0), (8.0, 0.0)], "y_true double, y_pred double")
    assert FC.residual_std(held, fitted).first().asDict() == {"residual_std": 1.0, "source": "validation"}
    assert FC.residual_std(held.limit(0), fitted).first().asDict() == {"residual_std": 4.0, "source": "training"}


def test_guard_and_known_entities(two, spark):
    status = {r["entity"]: r["status"] for r in FC.history_guard(two, 14).collect()}
    assert status == {"A": "insufficient_history", "B": "insufficient_history"}
    asked = spark.createDataFrame([("A",), ("Z",)], "entity string")
    assert {r["entity"]: r["known"] for r in FC.known_entities(asked, two).collect()} == {"A": True, "Z": False}


def test_arrays_in_step_order(two):
    row = FC.forecast_arrays(FC.with_interval(FC.seasonal_naive(two, 3).orderBy(F.desc("step")), 1.0)).where("series_id = 'B'").first()
    assert row["steps"] == [1, 2, 3] and row["point_forecast"] == [10.0, 20.0, 30.0]
    assert row["lower"] == [8.04, 18.04, 28.04] and row["interval_level"] == 0.95


def test_recursive_forecast_shape_and_range(panel, model):
    out = TR.recursive_forecast(panel, model, 12).collect()
    assert len(out) == 4 * 12 and all(math.isfinite(r["y_pred"]) for r in out)
    assert {str(r["date"]) for r in out if r["step"] == 12} == {"2024-03-12"}
    low, high = panel.agg(F.min("target"), F.max("target")).first()
    assert all(low <= r["y_pred"] <= high for r in out)


def test_recursive_forecast_follows_its_own_predictions(panel, model):
    """Each step equals scoring the panel extended by the previous predictions."""
    made = TR.recursive_forecast(panel, model, 3).orderBy("entity_id", "step")
    by_step = {(r["entity_id"], r["step"]): r["y_pred"] for r in made.collect()}
    known = made.where("step < 3").select(F.col("entity_id").alias("entity"), "date", F.col("y_pred").alias("target"))
    blank = made.where("step = 3").select(F.col("entity_id").alias("entity"), "date", F.lit(None).cast("double").alias("target"))
    extended = panel.drop("kind").unionByName(known).unionByName(blank)
    scored = model.transform(FE.add_features(extended).where("target is null").fillna(0))
    for r in scored.collect():
        assert r["prediction"] == pytest.approx(by_step[(r["entity"], 3)], abs=1e-9)


def test_recursive_forecast_ignores_partitioning_and_the_future(panel, model):
    key = ["entity_id", "step"]
    base = TR.recursive_forecast(panel, model, 2).orderBy(*key).collect()
    assert TR.recursive_forecast(panel.repartition(7), model, 2).orderBy(*key).collect() == base
    history = panel.where("date < '2024-02-20'")
    marked = panel.withColumn("target", F.when(F.col("date") >= "2024-02-20", 999.0).otherwise(F.col("target"))).where("date < '2024-02-20'")
    assert TR.recursive_forecast(history, model, 2).orderBy(*key).collect() == TR.recursive_forecast(marked, model, 2).orderBy(*key).collect()


def test_same_seed_same_trees_in_any_partitioning(panel):
    table = FE.add_features(panel)
    names = FE.feature_names(table.columns)
    first = TR.fit_trees(table, names, config=SMALL).stages[-1].toDebugString.split("\n", 1)[1]
    again = TR.fit_trees(table.repartition(5), names, config=SMALL).stages[-1].toDebugString.split("\n", 1)[1]
    assert first == again


def test_unknown_category_is_scored(panel):
    table = FE.add_features(panel)
    names = FE.feature_names(table.columns, exogenous=["kind"])
    model = TR.fit_trees(table, names, config=SMALL, categorical=["kind"])
    assert TR.model_features(model) == names and "kind" in names
    out = TR.recursive_forecast(panel.withColumn("kind", F.lit("new")), model, 2)
    assert out.where("y_pred is null").isEmpty() and out.count() == 8


def test_missing_history_counts_as_zero(panel, model):
    out = TR.recursive_forecast(panel.where("date < '2024-01-03'"), model, 1)
    assert out.count() == 4 and out.where("y_pred is null").isEmpty()


def test_importance_is_ranked(spark, model):
    rows = TR.feature_importance(spark, model, 3).collect()
    assert len(rows) == 3 and rows[0]["importance"] >= rows[1]["importance"] >= rows[2]["importance"] >= 0


def test_tree_backtest_scores_splits(panel, model):
    out = TR.backtest_trees(panel, model, 5, 3, strict=True).collect()
    assert len(out) == 4 * 3 and {r["horizon"] for r in out} == {5}


def test_training_run_compares_and_records(panel):
    settings = Settings(trees=SMALL, forecast=ForecastConfig(horizon=3))
    run = training.train_and_compare(panel.drop("kind"), settings)
    assert [r["role"] for r in run.comparison.orderBy("role").collect()] == ["baseline", "primary"]
    record = run.record.first()
    assert record["model_version"] == "v1" and record["feature_count"] == len(run.features) == 12
    assert (record["max_lag"], record["lookback_window"]) == (14, 14)
    assert record["sample_size"] == 4 * (48 - 14) and record["residual_std"] > 0
    assert record["training_date_range"]["end"] == "2024-02-17" and len(record["feature_importance"]) == 12
    out = training.batch_forecast(panel.drop("kind"), run.model, settings, record["residual_std"])
    assert out.count() == 12 and out.where("confidence_low < y_pred").count() == 12


def test_settings_merge_at_every_depth():
    merged = overlay(Settings(), {"monitor": {"mae_alert": 3.0}, "features": {"lags": [1, 2]}})
    assert merged.monitor.mae_alert == 3.0 and merged.monitor.window_days == 7 and merged.features.lags == (1, 2)
    with pytest.raises(ValueError, match="nonsense"):
        overlay(Settings(), {"nonsense": 1})
    assert (percent(0.2), percent(20.0), FeatureConfig().lookback) == (20.0, 20.0, 14)
