import numpy as np
import pytest
from pyspark.sql import functions as F

from tsspark.operators.clean import ClipRule, clip_outliers
from tsspark.operators.sketches import append_days, daily_sketches, merged_sketches, rank_error, replace_days, sketch_quantiles
from tsspark.operators.store_sales import median_fill

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.fixture(scope="module")
def panel(spark):
    """40 days of 3000 skewed values each; one value makes up a fifth of them."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    value = F.when(F.col("id") % 5 == 0, F.lit(7.0)).otherwise(F.exp(6 * draw))
    return spark.range(120_000).select(day.alias("date"), value.alias("y")).cache()


def off_by(values, found, shares):
    """How far the share lies outside the range of ranks that each found value has."""
    values = np.sort(values)
    low, high = np.searchsorted(values, found, "left") / len(values), np.searchsorted(values, found, "right") / len(values)
    return max(max(a - s, s - b, 0.0) for a, b, s in zip(low, high, shares, strict=True))


def test_rank_error_is_within_its_bound(panel):
    values = np.array([r["y"] for r in panel.collect()])
    for k in (64, 512):
        days = daily_sketches(panel, "y", k=k)
        assert days.count() == 40 and days.agg(F.sum("n")).first()[0] == 120_000
        found = sketch_quantiles(days, SHARES).first()["quantiles"]
        assert off_by(values, found, SHARES) <= rank_error(k)
        assert found[0] == values.min() and found[-1] == values.max()


def test_incremental_equals_rebuilt(panel):
    old, new = panel.where("date < '2024-01-20'"), panel.where("date >= '2024-01-20'")
    again = panel.where("date = '2024-01-10'").limit(50)
    kept = append_days(append_days(daily_sketches(old, "y"), daily_sketches(new, "y")), daily_sketches(again, "y"))
    rebuilt = daily_sketches(panel.unionByName(again), "y")
    facts = ["date", "n", "least", "greatest"]
    assert sorted(kept.select(*facts).collect()) == sorted(rebuilt.select(*facts).collect())
    values = np.array([r["y"] for r in panel.unionByName(again).collect()])
    for table in (kept, rebuilt):
        assert off_by(values, sketch_quantiles(table, SHARES).first()["quantiles"], SHARES) <= rank_error()
    whole = replace_days(kept, daily_sketches(panel.where("date = '2024-01-10'"), "y"))
    assert merged_sketches(whole).first()["n"] == 120_000


def test_small_sketches_hold_every_value(panel):
    few = panel.where("date < '2024-01-03'").limit(900)
    values = np.sort([r["y"] for r in few.collect()])
    parts = append_days(daily_sketches(few.where("date = '2024-01-01'"), "y"), daily_sketches(few.where("date = '2024-01-02'"), "y"))
    found = sketch_quantiles(parts, SHARES).first()["quantiles"]
    assert off_by(values, found, SHARES) == 0 and set(found) <= set(values.tolist())


def test_fences_from_sketches_near_the_exact_ones(panel):
    exact = clip_outliers(panel, ClipRule(by_quartiles=True), "y").agg(F.max("y")).first()[0]
    alone = clip_outliers(panel, ClipRule(by_quartiles=True, approximate=True), "y").agg(F.max("y")).first()[0]
    kept = clip_outliers(panel, ClipRule(by_quartiles=True), "y", daily_sketches(panel, "y")).agg(F.max("y")).first()[0]
    assert alone == pytest.approx(exact, rel=0.05) and kept == pytest.approx(exact, rel=0.05)
    assert clip_outliers(panel, ClipRule(lower=3.0, by_quartiles=True, approximate=True), "y").agg(F.min("y")).first()[0] == 3.0


def test_median_fill_from_a_sketch(spark, panel):
    holes = panel.withColumn("y", F.when(F.col("y") < 100, F.col("y")))
    median = holes.agg(F.expr("percentile(y, 0.5)")).first()[0]
    filled = median_fill(holes, "y", approximate=True)
    assert filled.where("y is null").count() == 0
    got = filled.where("y is not null").join(holes.where("y is null").limit(1).select(F.lit(1)), how="cross").agg(F.percentile("y", F.lit(0.5))).first()[0]
    assert got == pytest.approx(median, rel=0.05)
    empty = spark.createDataFrame([(None,), (None,)], "y double")
    assert [r["y"] for r in median_fill(empty, "y", approximate=True).collect()] == [0.0, 0.0]


def test_no_values_and_one_group_per_entity(spark):
    none = spark.createDataFrame([("2024-01-01", None)], "date string, y double")
    assert daily_sketches(none, "y").count() == 0
    assert [list(r["quantiles"]) for r in sketch_quantiles(daily_sketches(none, "y"), (0.5,)).collect()] == [[None]]
    per = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "date string, y double")
    got = {r["date"]: list(r["quantiles"]) for r in sketch_quantiles(daily_sketches(per, "y"), (0.0, 1.0), ["date"]).collect()}
    assert got == {"a": [1.0, 3.0], "b": [9.0, 9.0]}
