"""Importance resampling: draw the documents whose words look most like those of a target set, with reproducible noise.

Runs of words are hashed into buckets (CRC-32 modulo the number of buckets). A bucket's gain is the log ratio of its
smoothed shares in the target and in the documents; a document's weight is the sum of the gains of its features, looked up
in one array. The score adds Gumbel noise that follows from the id alone, so the highest scores are a draw without
replacement in proportion to the weights.

The cutoff is found without sorting all scores: a quantile sketch proposes a bracket of scores around it; exact counts
above and inside the bracket confirm it, or widen it; only the rows inside the bracket are sorted. Ranks of the drawn rows
come from a range partitioning: a position within the part, plus the sizes of the parts before it.

Null and empty texts have no features and weight 0; rows without an id are scored under the empty id and come last among
equal scores; repeated rows are scored and drawn row by row. Empty tables give empty results, an empty target leaves the
documents' own frequencies. Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import findable, in_batches, slices, stored, texts_of, word_lists

#: Every byte that is no part of a word becomes a blank, A-Z become a-z; bytes of characters beyond ASCII stay.
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_PLAIN = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Draw(NamedTuple):
    """Documents with ``least_words`` words or more compete for ``percent`` of their number."""

    percent: int = 10
    least_words: int = 20
    #: Features are the runs of 1 to ``longest`` words.
    longest: int = 1
    #: The tables of counts and gains have this many entries, whatever the corpus.
    buckets: int = 10_000
    seed: str = "2024"


#: Accuracy of the sketch, and half the width of the first bracket as a share of the rows: about twice the sketch's error.
SKETCH_K = 4096
HALF_WIDTH = 0.002


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each text, lower-cased, and where each text's words begin."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = bytes(memoryview(data)[offsets[0] : offsets[-1]]).translate(_PLAIN) if data is not None else b""
    flat = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))
    return word_lists(flat, lower=False)


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per run length: the bucket of each run, and where each text's runs begin."""
    words, starts = plain_words(texts)
    lengths = np.diff(starts)
    out, runs = [], words
    for size in range(1, longest + 1):
        if size > 1:  # runs of size - 1 that start at each word, and the word after
            runs = pc.binary_join_element_wise(runs.slice(0, max(len(words) - size + 1, 0)), words.slice(min(size - 1, len(words))), pa.scalar(" ", pa.large_string()))
        coded = runs.dictionary_encode()
        table = np.fromiter((crc32(w.as_buffer()) % buckets for w in coded.dictionary), np.int64, len(coded.dictionary))
        ids = table[coded.indices.to_numpy(zero_copy_only=False)] if len(runs) else np.empty(0, np.int64)
        own = np.maximum(lengths - size + 1, 0)
        begin = np.concatenate(([0], np.cumsum(own)))
        at = np.repeat(starts[:-1] - begin[:-1], own) + np.arange(begin[-1])  # leave out runs that cross into the next text
        out.append((ids[at], begin))
    return out


def bucket_counts(df: DataFrame, draw: Draw, text: str = "text") -> np.ndarray:
    """How many features fall into each bucket, over all rows; one number per bucket and task is sent."""
    longest, buckets = draw.longest, draw.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for ids, _ in feature_buckets(texts_of(part), longest, buckets):
                    total += np.bincount(ids, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    findable(df.sparkSession)
    rows = df.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares per bucket."""
    m, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = ((float(t + 1) * float(s_all + m)) / (float(s + 1) * float(t_all + m)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(name: str, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, n_words, n_features, weight, score) of every document, written to the shared folder; ``row`` tells repeated rows apart."""
    kind = dict(docs.dtypes)[key]
    table = gains(bucket_counts(docs, draw, text), bucket_counts(target, draw, text))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_features, weight = None, 0, 0
        for ids, starts in feature_buckets(texts_of(batch), draw.longest, draw.buckets):
            before = np.concatenate(([0], np.cumsum(table[ids])))
            n_words = np.diff(starts) if n_words is None else n_words
            n_features, weight = n_features + np.diff(starts), weight + before[starts[1:]] - before[starts[:-1]]
        chance = np.fromiter((noise(x, draw.seed) for x in batch.column("name").to_pylist()), np.int64, batch.num_rows)
        columns = [batch.column("key"), pa.array(n_words), pa.array(n_features), pa.array(weight), pa.array(weight + chance)]
        return pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_features", "weight", "score"])

    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))
    out = in_batches(own, work, f"key {kind}, n_words long, n_features long, weight long, score long")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "scores")


#: Higher scores first, then the smaller id.
ORDER = ("score", "key", "row")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]


def ranked(df: DataFrame) -> DataFrame:
    """``df`` with ``rank`` 1, 2, 3 ... in order; no task sees more than a range of it."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            place = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *place], [*batch.schema.names, "part", "place"])

    findable(df.sparkSession)
    parts = df.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    placed = stored(parts.mapInArrow(number, f"{kinds}, part int, place long"), "ranks")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.max("place").alias("n")).collect())  # a row per part
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).tolist()
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, before long")
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


class Cutoff(NamedTuple):
    size: int
    score: int
    key: object
    #: Rows in the bracket that was sorted, and how many brackets were tried.
    sorted_rows: int
    tries: int


def cutoff(rivals: DataFrame, percent: int, half_width: float = HALF_WIDTH, sketch_k: int = SKETCH_K) -> Cutoff | None:
    """The last row that is drawn from ``rivals``; None where nothing is drawn."""
    sketch = F.kll_sketch_agg_bigint("score", F.lit(sketch_k))
    summary = rivals.agg(F.count(F.lit(1)).alias("n"), sketch.alias("sketch")).first()
    size = percent * summary["n"] // 100
    if size == 0:
        return None
    middle, half, tries = 1 - size / summary["n"], half_width, 0
    while True:
        tries += 1
        ends = [x if 0 < x < 1 else None for x in (middle - half, middle + half)]
        low, high = _quantiles(rivals, bytes(summary["sketch"]), ends)
        above = F.col("score") > high if high is not None else F.lit(False)
        inside = ~above & (F.col("score") >= low if low is not None else F.lit(True))
        outside = rivals.agg(F.count_if(above).alias("above"), F.count_if(inside).alias("inside")).first()
        if outside["above"] < size <= outside["above"] + outside["inside"]:
            break
        half *= 4
    last = ranked(rivals.where(inside)).where(F.col("rank") == size - outside["above"]).first()
    return Cutoff(size, last["score"], last["key"], outside["inside"], tries)


def _quantiles(df: DataFrame, sketch: bytes, ends: list[float | None]) -> list[int | None]:
    one = df.sparkSession.range(1)
    found = one.select(*[F.kll_sketch_get_quantile_bigint(F.lit(sketch), F.lit(float(x))) if x is not None else F.lit(None) for x in ends]).first()
    return list(found)


def drawn(scores: DataFrame, draw: Draw = Draw(), half_width: float = HALF_WIDTH) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, 3 ... for the rows that are drawn, null for the others."""
    rival = F.col("n_words") >= draw.least_words
    last = cutoff(scores.where(rival), draw.percent, half_width)
    if last is None:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    tie = F.col("score") == last.score
    first = F.coalesce(rival & ((F.col("score") > last.score) | (tie & (F.col("key") <= F.lit(last.key) if last.key is not None else F.lit(True)))), F.lit(False))
    rank = F.when(F.col("rank") <= last.size, F.col("rank"))  # more than that only where rows with the last id repeat
    rest = scores.where(~first).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scores.where(first)).withColumn("rank", rank).select(*rest.columns).unionByName(rest)


def judged(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, n_features, weight, score, rank."""
    return drawn(scored(docs, target, draw, key, text), draw).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are drawn, with all their columns; of rows that share an id, all or none."""
    chosen = drawn(scored(docs, target, draw, key, text), draw).where(F.col("rank").isNotNull()).select(F.col("key").alias("__drawn")).distinct()
    return docs.join(chosen, F.col(key).eqNullSafe(F.col("__drawn")), "left_semi")
