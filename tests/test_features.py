import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsspark.config import FeatureConfig
from tsspark.operators import features as FE

PANEL = "date date, entity string, target double"


@pytest.fixture
def single(frame, days):
    return frame([(d, float(v)) for d, v in zip(days("2024-01-01", 5), (100, 200, 300, 400, 500), strict=True)], "date date, target double")


@pytest.fixture
def two(frame, days):
    d = days("2024-01-01", 5)
    return frame([(x, "A", float(i + 1)) for i, x in enumerate(d)] + [(x, "B", 100.0 * (i + 1)) for i, x in enumerate(d)], PANEL)


def last(df, entity):
    return df.where(F.col("entity") == entity).orderBy(F.col("date").desc()).first()


def test_single_series_without_entity(single):
    out = FE.add_features(single, entity=None)
    assert out.count() == 5
    rows = out.orderBy("date").collect()
    assert rows[-1]["lag_1"] == 400.0 and rows[0]["lag_1"] is None
    assert (rows[0]["day_of_week"], rows[0]["month"]) == (0, 1)


def test_entities_do_not_leak(two):
    out = FE.add_features(two, config=FeatureConfig(lags=(1,), windows=(3,)))
    a, b = last(out, "A"), last(out, "B")
    assert (a["lag_1"], b["lag_1"]) == (4.0, 400.0)
    assert (a["rolling_mean_3"], b["rolling_mean_3"]) == (3.0, 300.0)


def test_input_order_does_not_matter(two):
    shuffled = two.orderBy(F.rand(7)).repartition(3)
    key = ["entity", "date"]
    assert FE.add_features(shuffled).orderBy(*key).collect() == FE.add_features(two).orderBy(*key).collect()


def test_future_values_never_show(two):
    cut = "2024-01-03"
    changed = two.withColumn("target", F.when(F.col("date") > cut, 999.0).otherwise(F.col("target")))
    past = F.col("date") <= cut
    key = ["entity", "date"]
    assert FE.add_features(changed).where(past).orderBy(*key).collect() == FE.add_features(two).where(past).orderBy(*key).collect()


def test_rolling_matches_pandas(frame, days):
    values = [3.0, None, 5.0, 8.0, 1.0, None, None, 4.0, 9.0, 2.0]
    df = frame([(d, "A", v) for d, v in zip(days("2024-01-01", 10), values, strict=True)], PANEL)
    out = FE.add_features(df, config=FeatureConfig(lags=(2,), windows=(3,), min_periods=2)).orderBy("date").toPandas()
    past = pd.Series(values, dtype=float).shift(1).rolling(3, min_periods=2)
    pd.testing.assert_series_equal(out["rolling_mean_3"], past.mean(), check_names=False)
    pd.testing.assert_series_equal(out["rolling_std_3"], past.std(), check_names=False)


def test_iso_week_at_new_year(frame):
    out = FE.CalendarFeatures(date="date").transform(frame([("2021-01-03", "A", 1.0)], PANEL)).first()
    assert (out["week_of_year"], out["day_of_week"], out["is_weekend"]) == (53, 6, 1)


def test_lags_are_sorted_unique_and_positive(two):
    out = FE.LagFeatures(lags=[3, 1, 3, 0, -2]).transform(two)
    assert out.columns == ["date", "entity", "target", "lag_1", "lag_3"]


def test_missing_column_is_named(two):
    with pytest.raises(ValueError, match="target"):
        FE.LagFeatures().transform(two.drop("target"))


def test_one_shuffle_serves_all_windows(two):
    plan = FE.add_features(two)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("- Sort [") + plan.count("+ Sort [") == 1


def test_stages_equal_the_function(two, tmp_path):
    stages = FE.feature_stages()
    stages.write().save(str(tmp_path / "stages"))
    loaded = type(stages).load(str(tmp_path / "stages"))
    key = ["entity", "date"]
    assert loaded.transform(two).orderBy(*key).collect() == FE.add_features(two).orderBy(*key).collect()


def test_feature_names_ban_leaks():
    columns = ["date", "entity", "target", "target_raw", "lag_1", "rolling_mean_7", "month", "promo"]
    assert FE.feature_names(columns) == ["lag_1", "rolling_mean_7", "month"]
    assert FE.feature_names(columns, exogenous=["promo"])[-1] == "promo"
    with pytest.raises(ValueError, match="target_raw"):
        FE.feature_names(columns, exogenous=["target_raw"])
    with pytest.raises(ValueError, match="No feature"):
        FE.feature_names(["date", "entity", "target"])


def test_trained_features_are_enforced(two):
    table = FE.add_features(two)
    assert FE.enforce_features(table, ["month", "lag_1"]).columns == ["month", "lag_1"]
    with pytest.raises(ValueError, match="lag_99"):
        FE.enforce_features(table, ["lag_99"])


def test_warmup_and_base(two):
    table = FE.add_features(two, config=FeatureConfig(lags=(1, 2), windows=(2,)))
    names = FE.feature_names(table.columns)
    assert FE.drop_warmup(table, names).count() == 6
    assert FE.base_columns(table).columns == ["date", "entity", "target"]
