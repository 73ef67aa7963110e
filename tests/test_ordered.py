import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsspark.operators.ordered import exact_quantiles, half_split, ks_distance

SHARES = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


def quantiles(spark, values, **kw):
    df = spark.createDataFrame([(float(v),) if v is not None else (None,) for v in values], "x double")
    return exact_quantiles(df, "x", SHARES, **kw).first()["quantiles"]


@pytest.mark.parametrize("kind", ["normal", "hot", "few", "one"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=5000),
        "hot": np.concatenate([np.full(4000, 7.0), rng.normal(7, 3, size=2000)]),  # one value holds most rows
        "few": np.array([3.0, 1.0, 2.0]),
        "one": np.array([5.0]),
    }[kind]
    np.testing.assert_allclose(quantiles(spark, values), np.quantile(values, SHARES), rtol=1e-12)


def test_quantiles_skip_missing_and_survive_nothing(spark):
    assert quantiles(spark, [None, 1.0, 3.0])[3] == 2.0
    assert quantiles(spark, [None]) == [None] * len(SHARES)


def test_weights_repeat_rows(spark):
    df = spark.createDataFrame([(1.0, 5), (10.0, 2), (20.0, 2)], "x double, n int")
    expected = np.quantile([1.0] * 5 + [10.0] * 2 + [20.0] * 2, SHARES)
    np.testing.assert_allclose(exact_quantiles(df, "x", SHARES, weight="n").first()["quantiles"], expected)


@pytest.mark.parametrize("n_entities, n_days", [(1, 9), (7, 5), (300, 1), (40, 3)])
def test_halves_have_the_right_size_and_order(spark, n_entities, n_days):
    df = spark.range(n_entities).select(F.col("id").alias("entity"), F.explode(F.sequence(F.lit(1), F.lit(n_days))).alias("d"))
    df = df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), "d"))
    out = half_split(df).toPandas()
    early = out[out.half == "reference"]
    assert len(early) == n_entities * n_days // 2
    if len(early):
        assert early["date"].max() <= out[out.half == "current"]["date"].min()


def test_ks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    frames = []
    for feature, shift in (("a", 0.0), ("b", 0.5), ("c", 0.0)):
        ref, cur = rng.normal(size=400).round(2), rng.normal(shift, 1, size=300).round(2)
        if feature == "c":
            cur[:] = 0.0  # one value holds all current rows
        frames += [(feature, float(v), 1, 0) for v in ref] + [(feature, float(v), 0, 1) for v in cur]
    data = pd.DataFrame(frames, columns=["feature", "value", "n_ref", "n_cur"])
    counts = spark.createDataFrame(data.groupby(["feature", "value"], as_index=False).sum())
    got = {r["feature"]: r["ks"] for r in ks_distance(counts).collect()}
    for feature, part in data.groupby("feature"):
        grid = np.sort(part["value"].unique())
        ref, cur = part[part.n_ref == 1]["value"].to_numpy(), part[part.n_cur == 1]["value"].to_numpy()
        gaps = [abs((ref <= g).mean() - (cur <= g).mean()) for g in grid]
        assert got[feature] == pytest.approx(max(gaps), abs=1e-12)
