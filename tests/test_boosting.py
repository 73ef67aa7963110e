"""The fit of boosted trees, held against Spark ML's own."""

import os
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tsspark.config import TreeConfig
from tsspark.functions import histograms as H
from tsspark.operators import boosting as B
from tsspark.operators import trees as TR

FEATURES = ["x", "y", "flag", "still", "kind"]
CONFIG = TreeConfig(n_trees=6, max_depth=4, max_bins=32)


@pytest.fixture(scope="module")
def rows(spark):
    rng, first = random.Random(5), date(2024, 1, 1)
    made = []
    for i in range(600):
        x, y, flag, kind = rng.choice([0.0, 0.0, rng.gauss(0, 3)]), rng.randrange(12), rng.randrange(2), rng.choice("abcde")
        made.append(("s%d" % (i % 7), first + timedelta(days=i // 7), x, y, flag, 1.0, kind, x * y + 5 * flag + ord(kind) % 3 + rng.random()))
    return spark.createDataFrame(made, "entity string, date date, x double, y int, flag int, still double, kind string, target double").coalesce(1)


def by_spark(rows, config, parts):
    """Spark ML's fit on the same layout."""
    levels = StringIndexer(inputCol="kind", outputCol="kind__level", handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows)
    inputs = [f"{c}__level" if c == "kind" else c for c in FEATURES]
    put = VectorAssembler(inputCols=inputs, outputCol="features").transform(levels.transform(rows))
    laid = put.select("entity", "date", "features", "target").repartition(parts, "entity", "date").sortWithinPartitions("entity", "date")
    fit = GBTRegressor(labelCol="target", maxIter=config.n_trees, stepSize=config.learning_rate, maxDepth=config.max_depth, maxBins=config.max_bins, seed=config.seed)
    return fit.fit(laid.select("features", "target"))


def text(model):
    return model.toDebugString.split("\n", 1)[1]


def predictions(model, rows):
    levels = [r["prediction"] for r in model.transform(rows).orderBy("entity", "date", "x", "y", "target").collect()]
    return np.array(levels)


def test_the_trees_are_those_of_spark(rows):
    mine, theirs = TR.fit_trees(rows, FEATURES, config=CONFIG, categorical=["kind"]).stages[-1], by_spark(rows, CONFIG, 1)
    assert text(mine) == text(theirs)
    assert mine.featureImportances == theirs.featureImportances and mine.treeWeights == theirs.treeWeights


def test_many_candidates_are_sampled_alike(rows):
    """More rows than the sample: candidates follow from the same draw."""
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("x", F.col("x") + F.col("copy") / 97).drop("copy")
    config = TreeConfig(n_trees=2, max_depth=3, max_bins=32)
    mine, theirs = TR.fit_trees(many, FEATURES, config=config, categorical=["kind"]).stages[-1], by_spark(many, config, 1)
    assert mine.toDebugString.count("feature 0") > 0 and text(mine) == text(theirs)


def test_several_partitions_give_the_same_forecasts(rows, monkeypatch):
    """Bundled columns, siblings that follow from their parent."""
    whole = TR.fit_trees(rows, FEATURES, config=CONFIG, categorical=["kind"])
    monkeypatch.setattr(TR, "ROWS_PER_PART", 100)
    parted = TR.fit_trees(rows, FEATURES, config=CONFIG, categorical=["kind"])
    assert np.allclose(predictions(whole, rows), predictions(parted, rows), atol=1e-9)


def test_what_is_lost_from_a_disk_is_made_again(spark, rows, monkeypatch):
    monkeypatch.setattr(TR, "ROWS_PER_PART", 100)
    whole = TR.fit_trees(rows, FEATURES, config=CONFIG, categorical=["kind"])
    flattened, calls, folder = B.flattened, [], H.own_folder

    def lose(_):
        there = os.listdir(folder())
        doomed = [n for n in there if int(n.split("-")[1]) % 2 == 0] if len(calls) % 3 else [n for n in there if not n.endswith("-rows")]
        for n in doomed:
            os.remove(os.path.join(folder(), n))
        return [len(doomed)]

    def losing(*args):
        calls.append(spark.sparkContext.parallelize([0], 1).flatMap(lose).collect()[0])
        return flattened(*args)

    monkeypatch.setattr(B, "flattened", losing)
    again = TR.fit_trees(rows, FEATURES, config=CONFIG, categorical=["kind"])
    assert sum(calls) > 10 and text(again.stages[-1]) == text(whole.stages[-1])


def test_a_fit_leaves_no_files(spark, rows):
    TR.fit_trees(rows, FEATURES, config=CONFIG, categorical=["kind"])
    left = spark.sparkContext.parallelize(range(4), 4).flatMap(lambda _: os.listdir(H.own_folder())).collect()
    assert left == []


def test_constant_features_give_the_mean(rows):
    model = TR.fit_trees(rows, ["still"], config=CONFIG)
    mean = rows.agg(F.avg("target")).first()[0]
    assert model.transform(rows).agg(F.max(F.abs(F.col("prediction") - mean))).first()[0] < 1e-9


def test_no_rows_are_an_error(rows):
    with pytest.raises(ValueError, match="no row"):
        TR.fit_trees(rows.limit(0), ["x"], config=CONFIG)


def test_a_fit_takes_one_pass_of_few_tasks_for_a_level():
    assert B.tasks_of_a_pass(100, 1, 8) == 1
    assert B.tasks_of_a_pass(24_800_000, 48, 8) == 8  # 48 before
    assert B.tasks_of_a_pass(149_000_000, 149, 8) == 24
    sizes = [64, 64, 64, 64, 64, 64, 64, 7, 31, 53, 12, 2, 26]
    bundles = B.bundled(sizes)
    assert sorted(c for b in bundles for c in b) == list(range(13)) and len(bundles) == 6
    assert all(np.prod([sizes[c] for c in b]) <= 4096 for b in bundles)
    assert B.bundled([5000, 3]) == [[1], [0]]


def test_sums_of_bundles_are_those_of_their_columns():
    rng = np.random.default_rng(1)
    a, b, r = rng.integers(0, 5, 500), rng.integers(0, 7, 500), rng.normal(size=500)
    total = np.zeros((3, 2, 35))
    H.add_up(total, (a * 7 + b)[None, :], [35], r, [(0, np.arange(0, 200)), (1, np.arange(200, 500))])
    apart = H.unbundled(total, [[5, 7]])
    for g, rows in enumerate((slice(0, 200), slice(200, 500))):
        for at, (v, n) in zip((0, 5), ((a, 5), (b, 7)), strict=True):
            for s, w in enumerate((None, r[rows], r[rows] ** 2)):
                assert np.allclose(apart[s, g, at : at + n], np.bincount(v[rows], w, n))
