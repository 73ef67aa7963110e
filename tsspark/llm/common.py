"""What the text operators share: words, lower case, tasks that read whole batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsspark.session import scratch_path

#: A word is a run of characters other than these: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows that a Python task holds at once are at most this many characters, or one row.
BATCH_CHARS = 4_000_000


def findable(spark: SparkSession) -> None:
    """Let Python workers import this package where it was found here, whatever folder they start in.

    On a cluster the package is installed, or sent along with ``--py-files``; then this changes nothing.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def in_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on slices of each Arrow batch; a slice is bounded by the size of its texts, not by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
                del part, out
            del batch
            pa.default_memory_pool().release_unused()  # idle workers share the executor's memory with the next stage

    findable(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    if batch.nbytes <= BATCH_CHARS or rows <= 1:
        yield batch
        return
    half = rows // 2
    yield from slices(batch.slice(0, half))
    yield from slices(batch.slice(half))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(name)
    if column.offset:  # a cast of a slice goes wrong in some versions of the library, so the slice becomes an array of its own
        column = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(column.cast(pa.large_string()), "")


def word_lists(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and where each text's words begin (one more entry at the end)."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)  # the same six characters
    words = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    real = pc.greater(pc.binary_length(words), 0)
    kept = real.to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(kept)))[starts]
    return words.filter(real), at.astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    coded = words.dictionary_encode()
    values = coded.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mixed(hashes[:n] + np.uint64(0x9E3779B97F4A7C15))
    for k in range(1, width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k])
    return out


def in_groups(df: DataFrame, keys: list[str], order: list[str], parts: int, part: Column, work: Callable[[list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` on the rows of each group of equal ``keys``, in ``order``; ``part`` (0 to parts - 1) must follow from the keys.

    A task streams its sorted rows and holds one group at a time. ``work`` yields rows in the columns of ``schema``.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if held and own != key:
                    yield from packed(work(held))
                    held = []
                key = own
                held.append(row)
        if held:
            yield from packed(work(held))

    def packed(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        """Batches bounded by bytes."""
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, bytes)) + 100
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    findable(df.sparkSession)
    dealt = df.repartitionById(parts, part).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def list_column(values: np.ndarray | pa.Array, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share, and read from there: its plan is cut, lost tasks re-read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
