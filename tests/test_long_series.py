import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.config import FeatureConfig
from tsspark.operators.clean import fill_missing, reindex_daily
from tsspark.operators.features import RollingFeatures, add_features, feature_stages
from tsspark.operators.forecast import seasonal_naive
from tsspark.operators.long_series import LongSeries

SCHEMA = "date timestamp_ntz, n long, target double"


@pytest.fixture
def series(spark):
    """One series in shuffled rows; about a tenth of the targets is missing, three rows share each date."""

    def build(n, missing=0.1, seed=1):
        rng = random.Random(seed)
        start = datetime(2020, 1, 1)
        rows = [(start + timedelta(hours=7 * (k // 3)), k, None if rng.random() < missing else float(rng.randint(0, 99))) for k in range(n)]
        rng.shuffle(rows)
        return spark.createDataFrame(rows, SCHEMA).repartition(5)

    return build


def in_order(df, *columns):
    return [tuple(r) for r in df.orderBy("n").select(*columns).collect()]


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_features_equal_one_window_over_all_rows(series, size):
    df, config = series(240), FeatureConfig(lags=(1, 7, 60), windows=(4, 40), min_periods=2)
    made = [f"lag_{k}" for k in (1, 7, 60)] + [f"rolling_{s}_{w}" for s in ("mean", "std") for w in (4, 40)]
    got = add_features(df, entity=None, config=config, ties=("n",), block_rows=size)
    assert got.columns == add_features(df.withColumn("entity", F.lit(1)), config=config).drop("entity").columns
    order = W.partitionBy(F.lit(0)).orderBy("date", "n")
    for k, name in ((1, "lag_1"), (7, "lag_7"), (60, "lag_60")):
        assert in_order(got, name) == in_order(df.withColumn(name, F.lag("target", k).over(order)), name)
    frame = pd.DataFrame(in_order(df, "n", "target"), columns=["n", "y"])
    for w in (4, 40):
        past = frame["y"].shift(1).rolling(w, min_periods=2)
        for s, expected in (("mean", past.mean()), ("std", past.std())):
            values = [v for (v,) in in_order(got, f"rolling_{s}_{w}")]
            assert values == [None if pd.isna(x) else pytest.approx(x) for x in expected]
    assert len(made) == len(set(made) & set(got.columns)) and got.count() == 240


def test_blocks_are_bounded_and_halos_small(series):
    placed = LongSeries.of(series(6000), ("date", "n"), 200)
    sizes = [n for _, n in placed.sizes]
    assert sum(sizes) == 6000 and len(sizes) > 20 and max(sizes) < 400
    assert placed._halo(10).groupBy("_block").count().agg(F.max("count")).first()[0] == 10
    far = placed._halo(1000).groupBy("_block").count().collect()  # over several blocks
    assert max(r["count"] for r in far) == 1000


@pytest.mark.parametrize("missing", [0.1, 0.995, 1.0])
def test_carry_spans_blocks_without_a_value(series, missing):
    df = series(800, missing)
    got = fill_missing(df, entity=None, ties=("n",), block_rows=20)
    past = W.partitionBy(F.lit(0)).orderBy("date", "n").rowsBetween(W.unboundedPreceding, 0)
    expected = df.withColumn("target_cleaned", F.last("target", ignorenulls=True).over(past))
    assert in_order(got, "n", "target", "target_cleaned") == in_order(expected, "n", "target", "target_cleaned")
    assert fill_missing(df, "zero", entity=None).where("target_cleaned = 0").count() >= df.where("target is null").count()


def test_gaps_across_blocks(spark):
    rng = random.Random(4)
    days = sorted(rng.sample(range(3000), 300))
    rows = [((date(2015, 1, 1) + timedelta(days=d)).isoformat(), float(d)) for d in days]
    df = spark.createDataFrame([*rows, (None, 5.0)], "date string, target double").withColumn("date", F.col("date").cast("date"))
    for size in (7, 100, 1000):
        got = sorted((r["date"], r["target"]) for r in reindex_daily(df, entity=None, block_rows=size).collect())
        want = {date.fromisoformat(d): y for d, y in rows}
        span = [date.fromisoformat(rows[0][0]) + timedelta(days=k) for k in range(days[-1] - days[0] + 1)]
        assert got == [(d, want.get(d)) for d in span]


def test_chain_of_unfold_carry_and_features_shares_one_exchange(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=15 * k * k % 4995), float(k)) for k in range(60)]
    rows = list({d: (d, y) for d, y in rows}.values())
    df = spark.createDataFrame(rows, "date timestamp_ntz, target double")
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(15))
    chain = LongSeries.of(df, "date", 6).unfold("target", step).carry_forward("target", "filled")
    chain = chain.windowed(2, lambda s: {"lag_2": F.lag("filled", 2).over(s)})
    got = [tuple(r) for r in chain.frame().orderBy("date").select("date", "target", "filled", "lag_2").collect()]
    s = pd.DataFrame(df.orderBy("date").collect(), columns=["date", "y"]).set_index("date")["y"].asfreq("15min")
    filled = s.ffill()
    want = [(d.to_pydatetime(), None if pd.isna(a) else a, b, None if pd.isna(c) else c) for d, a, b, c in zip(s.index, s, filled, filled.shift(2), strict=True)]
    assert got == want


def test_one_series_of_many_rows(spark):
    """No block comes near the whole; the sums over all rows are those of the closed form."""
    n = 1_000_000
    df = spark.range(n).select(F.timestamp_seconds(F.col("id") * 60).alias("date"), F.col("id").cast("double").alias("target"))
    placed = LongSeries.of(df, "date", 100_000)
    assert max(rows for _, rows in placed.sizes) < 200_000
    out = placed.windowed(14, lambda s: {"lag_14": F.lag("target", 14).over(s), "mean_7": F.avg("target").over(s.rowsBetween(-7, -1))})
    row = out.frame().agg(F.sum("lag_14").alias("lag"), F.count("lag_14").alias("k"), F.sum("mean_7").alias("mean")).first()
    assert (row["k"], row["lag"]) == (n - 14, (n - 15) * (n - 14) / 2)
    early = sum(sum(range(i)) / i for i in range(1, 7))
    assert row["mean"] == pytest.approx(early + sum(k - 4.0 for k in range(7, n)), rel=1e-12)


def test_empty_series_one_row_and_missing_dates(spark, series):
    empty = series(30).limit(0)
    assert add_features(empty, entity=None).count() == 0 and fill_missing(empty, entity=None).count() == 0
    assert reindex_daily(empty, entity=None).count() == 0
    one = series(1, 0.0)
    assert [r["lag_1"] for r in add_features(one, entity=None).collect()] == [None]
    df = spark.createDataFrame([(None, 1, 5.0), (datetime(2024, 1, 1), 2, 7.0)], SCHEMA)
    assert in_order(add_features(df, entity=None, block_rows=1), "n", "lag_1") == [(1, None), (2, 5.0)]
    with pytest.raises(ValueError, match="columns"):
        LongSeries.of(df, ("day",))


def test_transformers_without_an_entity(series):
    df = series(200).where("n % 3 = 0")
    got = feature_stages(entity=None).transform(df)
    want = add_features(df, entity=None)
    assert in_order(got, *want.columns) == in_order(want, *want.columns)
    with pytest.raises(ValueError, match="date"):
        RollingFeatures(entity="", windows=[3]).transform(df.drop("date"))


def test_naive_forecast_of_one_series(series):
    df = series(60, 0.0).where("n % 3 = 0")
    values = [r["target"] for r in df.orderBy("date").collect()]
    out = seasonal_naive(df, 9, k=4, entity=None, offset="7h").orderBy("step").collect()
    assert [r["y_pred"] for r in out] == [values[-4 + h % 4] for h in range(9)]
    assert [r["date"] for r in out] == [datetime(2020, 1, 1) + timedelta(hours=7 * (19 + h)) for h in range(1, 10)]
    assert {r["entity_id"] for r in out} == {None}
    assert seasonal_naive(df, 9, k=100, entity=None).count() == 0
