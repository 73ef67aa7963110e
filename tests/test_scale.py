"""Steps whose cost must not outgrow the input: passes of a fit, blocks, windows, unfolded days, buckets."""

import random

import pytest
from pyspark.sql import functions as F

from tsspark.config import Settings, TreeConfig, overlay
from tsspark.operators import backtest as B
from tsspark.operators import clean as C
from tsspark.operators import history as H
from tsspark.operators import long_series as L
from tsspark.operators import trees as TR
from tsspark.operators.forecast import label_split
from tsspark.plans import catalog_models as CM
from tsspark.plans import training
from tsspark.sources.keyed import ROWS_PER_FILE, KeyedTable, newest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_of_a_fit_stay_few():
    assert [TR.fit_parts(n) for n in (0, 1, 64_000, 64_001, 640_000)] == [1, 1, 1, 2, 10]
    assert TR.fit_parts(26_000_000) == 48  # 407 before
    assert TR.fit_parts(156_000_000) == 156  # no partition beyond a million rows


def test_a_fit_writes_few_checkpoints(spark):
    """Every 20 trees, not every 10; a fit that is cut off once on its way has the trees of one that is cut off never."""
    days = [F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit("a").alias("entity")]
    rows = spark.range(120).select(*days, (F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") * 11 % 17).cast("double").alias("target"))
    config = TreeConfig(n_trees=23, max_depth=2)
    fit = TR.fit_trees(rows, ["x"], config=config).stages[-1]
    assert fit.getCheckpointInterval() == 20  # 10 before
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(TR, "TREES_PER_CHECKPOINT", -1)
        never = TR.fit_trees(rows, ["x"], config=config).stages[-1]
    assert never.toDebugString.split("\n", 1)[1] == fit.toDebugString.split("\n", 1)[1]


def test_a_fit_computes_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(v):
        read.add(1)
        return float(v % 7)

    seen = F.udf(count, "double").asNondeterministic()  # else it is evaluated once more for the filter
    rows = spark.range(200).select(
        F.lit("a").alias("entity"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        seen("id").alias("x"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("target"),
    )
    TR.fit_trees(rows, ["x", "kind"], config=TreeConfig(n_trees=2, max_depth=2), categorical=["kind"])
    assert read.value == 200


def test_validation_rows_are_left_out_before_their_features_are_made(frame, days, monkeypatch):
    rows = [(e, d, float(i * k % 11)) for e, k in (("a", 3), ("b", 7)) for i, d in enumerate(days("2024-01-01", 50)) if (i + k) % 9]
    panel, seen = frame(rows, "entity string, date date, target double"), []
    monkeypatch.setattr(training, "_tree_fit", lambda train, *rest: seen.append(train))
    _, features = training.fit_on_history(panel)
    optimized = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in optimized[optimized.rindex("Window [") :]  # above the windows before
    labelled = label_split(training.featured_panel(panel))
    want = labelled.where(F.col("split") == "train").drop("split")
    assert sorted(map(tuple, seen[0].collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "split" not in seen[0].columns and len(features) == 12


@pytest.mark.parametrize("query", ["recursive_forecast", "batch_forecast", "save_and_load_model", "model_round_trip"])
def test_a_query_adds_up_its_daily_sales_once(spark, tmp_path, monkeypatch, query):
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-03-10").cast("date")))
    lines = spark.range(3).select((F.col("id") + 1).alias("l_suppkey"), days.alias("l_shipdate"))
    lines.withColumn("l_quantity", (F.dayofyear("l_shipdate") * 7 % 31 + F.col("l_suppkey")).cast("double")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 4).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(2).select(F.col("id").alias("n_nationkey"), F.col("id").cast("string").alias("n_name"), F.lit(0).alias("n_regionkey")).write.parquet(f"{tmp_path}/nation.parquet")
    read, sales = spark.sparkContext.accumulator(0), CM._sales

    def count(v):
        read.add(1)
        return v

    seen = F.udf(count, "double").asNondeterministic()
    monkeypatch.setattr(CM, "_sales", lambda *at: sales(*at).withColumn("target", seen("target")))
    monkeypatch.setattr(CM, "SETTINGS", overlay(Settings(), {"trees": {"n_trees": 2, "max_depth": 2}}))
    others = set(spark.sparkContext._jsc.getPersistentRDDs())
    made = getattr(CM, query)(spark, str(tmp_path))
    n = {"recursive_forecast": 42, "batch_forecast": 90, "save_and_load_model": 21, "model_round_trip": 1}[query]
    assert made.count() == n
    assert read.value == 210  # every panel, fit and record read the lines again before
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= others


def test_the_state_of_a_forecast_has_few_tasks(spark, frame, days, monkeypatch):
    rows = [(e, d, float(i)) for e in "abcdefgh" for i, d in enumerate(days("2024-01-01", 40))]
    panel = frame(rows, "entity string, date date, target double").repartition(64, "entity")
    seen, roll = [], TR.roll_forward
    monkeypatch.setattr(TR, "roll_forward", lambda state, *rest: (seen.append(state), roll(state, *rest))[1])
    forecast = TR.recursive_forecast(panel, CM.linear_model(), 3)
    assert seen[0].rdd.getNumPartitions() <= 8  # 64 before
    assert forecast.count() == 24


@pytest.mark.parametrize("per_entity", [True, False])
def test_a_rolling_mean_costs_the_same_for_any_window(spark, frame, days, per_entity):
    rng, w = random.Random(3), 5
    points = [(e, d, None if rng.random() < 0.1 else rng.randrange(10**6) / 10**6, rng.randrange(10**8) / 10**8) for e in "ab" for d in days("2024-01-01", 40)]
    history = frame(points, "entity string, date date, abs_error double, ape double")
    out = H.rolling_error_series(history, w, per_entity=per_entity, block=7)
    assert f"RowFrame, -{w - 1}, currentrow$" not in plan(out)
    order = sorted(points, key=(lambda p: (p[0], p[1])) if per_entity else (lambda p: (p[1], p[0])))
    want = {}
    for run in ([[p for p in order if p[0] == e] for e in "ab"] if per_entity else [order]):
        for i in range(w - 1, len(run)):
            held, ape = [p[2] for p in run[i - w + 1 : i + 1] if p[2] is not None], [p[3] for p in run[i - w + 1 : i + 1]]
            if held:
                want[run[i][:2]] = (sum(held) / len(held), 100 * sum(ape) / w)
    got = {(r["entity"], str(r["date"])): (r["mae"], r["mape"]) for r in out.collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_blocks_grow_before_their_number_does():
    assert L.block_rows(100_000, 250) == 250
    assert L.block_rows(6_000_000, 250) == 12_000  # 24,000 blocks before
    assert L.block_rows(10**10, 250) == L.BLOCK_ROWS
    assert L.block_rows(10**10, 5 * L.BLOCK_ROWS) == 5 * L.BLOCK_ROWS


def test_a_series_of_many_blocks_is_filled_alike(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BLOCKS", 4)
    rows = spark.range(400).select(F.col("id").alias("date"), F.when(F.col("id") % 97 == 5, F.col("id")).cast("double").alias("target"))
    series = L.LongSeries.of(rows, "date", 10)
    assert len(series.sizes) <= 4
    filled = {r["date"]: r["y"] for r in series.carry_forward("target", "y").frame().collect()}
    assert filled == {i: None if i < 5 else float((i - 5) // 97 * 97 + 5) for i in range(400)}


def test_newer_points_are_compared_without_a_second_copy(spark, frame):
    rows = frame([("a", "2024-01-01", 1.0, 3.0, 1), ("a", "2024-01-01", 1.0, 2.0, 2)], "entity string, date date, y_true double, y_pred double, at int")
    out = H.append_errors(None, rows, order="at")
    assert "max_by(" not in plan(out)
    assert [r["abs_error"] for r in out.collect()] == [1.0]


def test_a_large_bucket_gets_more_files(spark, frame, tmp_path):
    schema = frame([("a", "2024-01-01", 1.0)], "entity string, date date, y double").schema
    table = KeyedTable(spark, str(tmp_path), schema, ("entity", "date"), files=2)
    assert [table._files_for(n, 14) for n in (0, 14 * ROWS_PER_FILE, 70 * ROWS_PER_FILE)] == [2, 2, 5]
    for value in (1.0, 2.0):
        table.upsert(frame([("a", "2024-01-01", value), ("b", "2024-01-02", value)], "entity string, date date, y double"), newest(("entity", "date"), ()))
    assert [tuple(r)[2] for r in table.read().collect()] == [2.0, 2.0]


def test_a_rolling_mean_just_below_a_rounding_edge_stays_there(spark, frame, days):
    points = [("a", d, 0.5, 0.00018249 if k == 3 else 0.0) for k, d in enumerate(days("2024-01-01", 365))]
    out = H.rolling_error_series(frame(points, "entity string, date date, abs_error double, ape double"), 365, bounds=(2, None))
    assert [r["mape"] for r in out.collect()] == [0.0]  # 0.0000499973


@pytest.mark.parametrize("span", ["per_entity", "global"])
@pytest.mark.parametrize("strategy", ["forward_fill", "zero"])
def test_unfolded_days_are_not_sorted(spark, frame, days, span, strategy):
    rng = random.Random(7)
    rows = [(e, d, rng.choice([None, 1.0, 2.5, 4.0])) for e in "abc" for d in days("2024-01-01", 60) if rng.random() < 0.3]
    panel = frame(rows, "entity string, date date, target double")
    out = C.clean_retail(panel, span=span, strategy=strategy)
    assert plan(out).count("Sort [") == 1
    apart = C.fill_missing(C.reindex_daily(panel, span=span), strategy)
    assert sorted(out.collect(), key=str) == sorted(apart.select(*out.columns).collect(), key=str)


def test_rows_near_a_cutoff_pass_the_first_test(spark):
    base = spark.range(1, 60).select(F.col("id").cast("int").alias("n")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at, n, lost, may_all = F.col("at"), F.col("n"), F.lit(0), []

    def hit(tail, horizon):
        return lambda p: (at > p - tail) & (at <= p + horizon)

    for splits, horizon, tail, first, strict in ((1, 7, 7, 15, False), (2, 1, 19, 0, True), (3, 14, 7, 14, False), (5, 7, 7, 15, False), (20, 3, 2, 15, True)):
        cuts = F.coalesce(B._cutoff_positions(n, horizon, splits, first, strict), F.array().cast("array<int>"))
        near = F.exists(cuts, hit(tail, horizon))
        may = F.coalesce(B._maybe_near(at, n, horizon, splits, tail, first, strict), F.lit(False))
        lost = lost + F.when(near & ~may, 1).otherwise(0)
        may_all.append(F.count_if(may & ~near).alias(f"more_{splits}"))
    found = base.agg(F.sum(lost).alias("lost"), *may_all, F.count(F.lit(1)).alias("rows")).first()
    assert found["lost"] == 0
    assert found["more_5"] < found["rows"] / 4
