"""The fit of boosted regression trees, over columns that are binned once.

Split candidates, gains, the order of equal gains and the leaves are those of Spark ML's ``GBTRegressor`` for squared
loss, and the result is its model. What differs is how rows are added up: tasks hold bins as small numbers and add whole
columns in NumPy. A pass takes one level of a tree; the trees so far travel with it.

The binned rows, and their forecasts by the finished trees, are files on the executor's own disk. They are only a shortcut:
rows that a task doesn't find, on another machine or after a loss, are binned again, and forecasts follow from the trees.
"""

from __future__ import annotations

import json
import math
import pickle
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession

from tsspark.functions.histograms import Chunk, Flat, Pass, forget, keep
from tsspark.session import findable, scratch_path

#: Rows that a task works on at once, but for the rest of an Arrow batch.
CHUNK = 65_536
#: Rows that choose the split candidates, unless the square of the bins is more.
SAMPLED = 10_000
#: Sampled values that the driver holds at once, but for a single column.
CELLS = 5_000_000
#: Codes of a bundle of columns.
MOST_CODES = 4096
#: Rows of a task, where there are more than one task per core needs.
ROWS_PER_TASK = 8_000_000
LOWEST = -math.inf


@dataclass(frozen=True)
class Bins:
    """How the values of one column become bins: candidates between values, or levels as they are."""

    thresholds: np.ndarray
    levels: int = 0

    @property
    def size(self) -> int:
        return self.levels or len(self.thresholds) + 1


@dataclass
class Node:
    """A node of a growing tree; ``stats`` are count, sum and sum of squares of its labels."""

    stats: np.ndarray | None = None
    impurity: float = math.nan
    gain: float = -1.0
    valid: bool = True
    column: int = -1
    lefts: np.ndarray | None = None  # whether a bin goes left
    children: list[Node] = field(default_factory=list)

    @property
    def prediction(self) -> float:
        return float(self.stats[1] / self.stats[0])


# ---- split candidates --------------------------------------------------------------------------------


def candidates(sample: np.ndarray, most: int, expected: float) -> np.ndarray:
    """Thresholds of one column from its sampled values; ``expected`` is the size of the sample as it was asked for."""
    values, counts = np.unique(sample[sample != 0.0] + 0.0, return_counts=True)
    if len(values) == 0:
        return np.empty(0)
    counts, seen = counts.astype(float), float(counts.sum())
    if expected - seen > np.finfo(float).eps * seen * 100:  # zeros are not counted but inferred
        at = int(np.searchsorted(values, 0.0))
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, expected - seen)
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2.0
    stride, found = expected / (most + 1), []
    before, wanted = float(counts[0]), stride
    for k in range(1, len(values)):
        after = before + float(counts[k])
        if abs(before - wanted) < abs(after - wanted):
            found.append((values[k - 1] + values[k]) / 2.0)
            wanted += stride
        before = after
    return np.array(found)


def _binning(laid: DataFrame, columns: Sequence[str], levels: dict[str, int], n_rows: int, max_bins: int, seed: int) -> list[Bins]:
    """Candidates of all columns, from a sample of the rows that follows from their layout and the seed."""
    spark, most = laid.sparkSession, min(max_bins, n_rows)
    share = min(max(most * most, SAMPLED) / n_rows, 1.0)
    sample = laid.select(*columns)
    if share < 1:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = sample._jdf.javaRDD().sample(False, share, draw)
        sample = DataFrame(spark._jsparkSession.createDataFrame(rows, sample._jdf.schema()), spark)
    expected, bins = share * n_rows, {c: Bins(np.empty(0), n) for c, n in levels.items()}
    free, step = [c for c in columns if c not in levels], max(1, int(CELLS // expected))
    for k in range(0, len(free), step):
        drawn = sample.select(*free[k : k + step]).toArrow()
        bins |= {c: Bins(candidates(drawn.column(c).to_numpy(), most - 1, expected)) for c in drawn.column_names}
    return [bins[c] for c in columns]


def bundled(sizes: Sequence[int]) -> list[list[int]]:
    """Columns to be added up together: as many as ``MOST_CODES`` allows, those of few bins first."""
    out, codes = [], 0
    for column in sorted(range(len(sizes)), key=lambda c: sizes[c]):
        if out and codes * sizes[column] <= MOST_CODES:
            out[-1].append(column)
            codes *= sizes[column]
        else:
            out.append([column])
            codes = sizes[column]
    return out


def tasks_of_a_pass(n_rows: int, parts: int, slots: int) -> int:
    """A task costs some 50 ms before its first row, so there is one per core until these have ``ROWS_PER_TASK`` each."""
    return max(1, min(parts, slots * -(-n_rows // (slots * ROWS_PER_TASK))))


def _kept(laid: DataFrame, columns: Sequence[str], target: str, bins: Sequence[Bins], bundles: Sequence[Sequence[int]], fit: str, tasks: int) -> RDD:
    """One element per task: what it has written to the disk of its executor, the binned rows of ``laid`` in their order."""
    sizes, edges = [b.size for b in bins], [None if b.levels else b.thresholds for b in bins]
    kind = np.min_scalar_type(max(math.prod(sizes[c] for c in bundle) for bundle in bundles) - 1)

    def chunk(batches: list[pa.RecordBatch]) -> Chunk:
        rows, codes = pa.Table.from_batches(batches), []
        for bundle in bundles:
            code = 0
            for c in bundle:
                values = rows.column(columns[c]).to_numpy()
                code = code * sizes[c] + (values.astype(np.int64) if edges[c] is None else np.searchsorted(edges[c], values))
            codes.append(code.astype(kind))
        return np.stack(codes), rows.column(target).to_numpy()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield chunk(held)
                held, size = [], 0
        if size:
            yield chunk(held)

    made = pa.schema({"part": pa.int64(), "kind": pa.string(), "lengths": pa.list_(pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "kind": kind.str, "lengths": keep(fit, part, chunks(batches))}], schema=made)

    findable(laid.sparkSession)
    return laid.coalesce(tasks).mapInArrow(run, "part bigint, kind string, lengths array<bigint>").rdd


# ---- splits, on the driver ---------------------------------------------------------------------------


def _impurity(stats: np.ndarray) -> np.ndarray:
    """Variance, of statistics along the first axis."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(stats[0] == 0, 0.0, (stats[2] - stats[1] * stats[1] / stats[0]) / stats[0])


def choose(node: Node, total: np.ndarray, bins: Sequence[Bins]) -> None:
    """Set the best split of a node from its sums by bin, or leave it a leaf. Of equal gains the first column and the lowest bin win."""
    best, at = None, 0
    for column, b in enumerate(bins):
        sums = total[:, at : at + b.size]
        at += b.size
        if b.size < 2:
            if node.stats is None and column == len(bins) - 1:
                node.stats, node.impurity = sums.sum(axis=1), float(_impurity(sums.sum(axis=1)))
            continue
        order = None
        if b.levels:
            with np.errstate(divide="ignore", invalid="ignore"):
                order = np.argsort(np.where(sums[0] == 0, np.finfo(float).max, sums[1] / sums[0]), kind="stable")
            sums = sums[:, order]
        upto = np.cumsum(sums, axis=1)
        left, right = upto[:, :-1], upto[:, -1:] - upto[:, :-1]
        if node.stats is None:
            node.stats = left[:, 0] + right[:, 0]
            node.impurity = float(_impurity(node.stats))
        n = left[0] + right[0]
        gain = node.impurity - left[0] / n * _impurity(left) - right[0] / n * _impurity(right)
        gain = np.where((left[0] < 1) | (right[0] < 1) | (gain < 0), LOWEST, gain)
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0]:
            places = np.arange(b.size)
            lefts = places <= k if order is None else np.isin(places, order[: k + 1])
            best = (float(gain[k]), column, lefts, left[:, k].copy(), right[:, k].copy())
    if best is None or best[0] == LOWEST:
        node.valid = False
    elif best[0] > 0:
        node.gain, node.column, node.lefts = best[:3]
        node.children = [Node(s, float(_impurity(s))) for s in best[3:]]


def flattened(root: Node, bundles: Sequence[Sequence[int]]) -> tuple[Flat, dict[int, int]]:
    """A tree as tasks read it, and the place of each node by identity."""
    flat, place, todo = [], {}, [root]
    home = {c: (k, at) for k, bundle in enumerate(bundles) for at, c in enumerate(bundle)}
    for node in todo:
        place[id(node)] = len(place)
        todo.extend(node.children)
    for node in todo:
        value = 0.0 if node.stats is None else node.prediction
        if node.children:
            flat.append((*home[node.column], node.lefts, *(place[id(c)] for c in node.children), value))
        else:
            flat.append((-1, -1, None, -1, -1, value))
    return flat, place


def _open(node: Node) -> bool:
    return node.stats is None or not abs(node.impurity) < np.finfo(float).eps


#: (root, some of its leaves) to the sums by bin of each, from one pass.
Sums = Callable[[Node, Sequence[Node]], np.ndarray]


def _grow(sums: Sums, depth: int, bins: Sequence[Bins], apart: bool) -> Node:
    """One tree, level by level.

    Of two siblings only the smaller one is added up, and the other one follows from their parent. Where all rows are in one
    partition, nodes are added up ``apart``, in the order of the rows, as Spark ML does, to the last bit.
    """
    root, known = Node(), {}
    families = [(None, [root])]
    for _ in range(depth):
        asked, follow = [], []
        for parent, nodes in families:
            wanted = [node for node in nodes if _open(node)]
            if parent is None or apart or not wanted:
                asked += wanted
            else:
                small, large = sorted(nodes, key=lambda node: node.stats[0])
                asked.append(small)
                follow.append((parent, small, large))
        if not asked:
            break
        found = {id(node): total for node, total in zip(asked, sums(root, asked), strict=True)}
        for parent, small, large in follow:
            other = known[id(parent)] - found[id(small)]
            found[id(large)] = np.where(other[0] == 0, 0.0, other)
        level = [node for _, nodes in families for node in nodes if _open(node)]
        for node in level:
            choose(node, found[id(node)], bins)
        families, known = [(node, node.children) for node in level if node.children], found
    return root


def _pruned(node: Node) -> Node:
    """``node`` with splits taken back whose two leaves say the same."""
    if node.children:
        node.children = [_pruned(c) for c in node.children]
        if not any(c.children for c in node.children) and node.children[0].prediction == node.children[1].prediction:
            node.children, node.column, node.gain = [], -1, -1.0
    return node


@dataclass(frozen=True)
class Grown:
    bins: list[Bins]
    roots: list[Node]
    weights: list[float]


def grow_trees(laid: DataFrame, columns: Sequence[str], target: str, levels: dict[str, int], settings: GBTRegressor) -> Grown:
    """All trees of ``settings`` on ``columns`` (doubles, in the order of its features) of ``laid``; runs jobs.

    ``levels`` gives the number of levels of the columns that hold levels. A partition is read in its order.
    """
    context, n_rows = laid.sparkSession.sparkContext, laid.count()
    if n_rows == 0:
        raise ValueError("Trees can't be fitted: no row has a target and all features.")
    bins = _binning(laid, columns, levels, n_rows, settings.getMaxBins(), settings.getSeed())
    fit, sizes, slots = uuid.uuid4().hex, [b.size for b in bins], context.defaultParallelism
    parts = laid.rdd.getNumPartitions()
    apart = parts == 1
    bundles = [[c] for c in range(len(sizes))] if apart else bundled(sizes)
    by_bundle = [sizes[c] for bundle in bundles for c in bundle]
    starts = np.cumsum([0, *by_bundle])
    order = [c for bundle in bundles for c in bundle]
    in_order = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in np.argsort(order)])
    written = _kept(laid, columns, target, bins, bundles, fit, tasks_of_a_pass(n_rows, parts, slots))
    kept = written.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)  # a task is sent where its part of this is
    roots, trees, weights = [], [], []

    def sums(root: Node, asked: Sequence[Node]) -> np.ndarray:
        growing, place = flattened(root, bundles)
        wanted = {place[id(node)]: g for g, node in enumerate(asked)}
        one = Pass(fit, [[sizes[c] for c in bundle] for bundle in bundles], trees, weights, growing, wanted)
        found = dict(kept.mapPartitions(one.run).collect())
        absent = [part for part, total in found.items() if total is None]
        if absent:
            found |= dict(context.runJob(written.mapPartitions(one.run), list, absent))
        total = 0.0
        for part in sorted(found):
            total = total + found[part]
        return total.transpose(1, 0, 2)[:, :, in_order]

    try:
        for k in range(settings.getMaxIter()):
            roots.append(_pruned(_grow(sums, settings.getMaxDepth(), bins, apart)))
            trees.append(pickle.dumps(flattened(roots[-1], bundles)[0]))
            weights.append(settings.getStepSize() if k else 1.0)
    finally:
        kept.unpersist()
        context.parallelize(range(slots), slots).foreach(lambda _: forget(fit))
    return Grown(bins, roots, weights)


def as_model(spark: SparkSession, grown: Grown, settings: GBTRegressor) -> GBTRegressionModel:
    """The first trees, as many as ``settings`` has, as Spark ML's model, by way of the form in which it stores one."""
    bins, roots = grown.bins, grown.roots[: settings.getMaxIter()]
    base = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    given = {p.name: settings.getOrDefault(p) for p in settings.params if settings.isSet(p)}
    usual = {p.name: settings.getOrDefault(p) for p in settings.params if settings.hasDefault(p) and not settings.isSet(p)}
    about = base | {"class": "org.apache.spark.ml.regression.GBTRegressionModel", "uid": settings.uid, "paramMap": given, "defaultParamMap": usual}
    of_tree = {k: v for k, v in (usual | given).items() if k in ("checkpointInterval", "labelCol", "maxBins", "maxDepth", "seed")}
    nodes, kinds = [], []
    for tree, (root, weight) in enumerate(zip(roots, grown.weights, strict=False)):
        nodes += [(tree, row) for row in _stored(root, bins)]
        one = base | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": f"dtr_{uuid.uuid4().hex[:12]}", "paramMap": of_tree, "defaultParamMap": {}}
        kinds.append((tree, json.dumps(one), weight))
    path = scratch_path(spark, "trees")
    whole = json.dumps(about | {"numFeatures": len(bins), "numTrees": len(roots)})
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(kinds, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, STORED_NODE).coalesce(1).write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


#: Fixed by Spark ML: a stored node.
STORED_NODE = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def _stored(root: Node, bins: Sequence[Bins]) -> list[tuple]:
    """The nodes of a tree as stored rows, a node before its left side, that before the right one."""
    rows = []

    def add(node: Node) -> int:
        at = len(rows)
        rows.append(None)
        split, left, right = (-1, [], -1), -1, -1
        if node.children:
            b = bins[node.column]
            if b.levels:
                split = (node.column, [float(v) for v in np.flatnonzero(node.lefts)], b.levels)
            else:
                split = (node.column, [float(b.thresholds[node.lefts.sum() - 1])], -1)
            left, right = add(node.children[0]), add(node.children[1])
        impurity = node.impurity if node.valid else -1.0
        rows[at] = (at, node.prediction, impurity, [float(s) for s in node.stats], int(node.stats[0]), node.gain, left, right, split)
        return at

    add(root)
    return rows
