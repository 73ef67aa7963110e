"""Byte-level BPE with a local rank file.

The library that does the merges is called once per text, or per part of a long text. Parts end where a
blank or line feed follows a visible ASCII character: no match of the split pattern runs over such a place
and none looks back, so the parts' ids joined are the ids of the whole text.

Null texts count as empty and have no ids. Tokenisers live once per Python worker.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import in_batches, list_column, texts_of

#: Texts longer than this many characters are encoded in parts of about this size.
PART_CHARS = 50_000
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text cut at safe places, each part at least ``size`` long but for the last."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``, the token ids of each whole text. One row per input row; no shuffle.

    The rank file is opened by the tasks: it is part of the installed environment of every executor.
    """
    kind = dict(df.dtypes)[key]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = encoding(rank_file, pattern)
        found = [np.concatenate([code.encode_to_numpy(p) for p in parts(t)]) if t else np.empty(0, np.uint32) for t in texts_of(batch).to_pylist()]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([batch.column("key"), list_column(flat, starts, pa.int32())], ["key", "ids"])

    return in_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and ``decoded``, the bytes the ids stand for. Ids need not end at a character's end."""
    kind = dict(df.dtypes)[key]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = encoding(rank_file, pattern)
        raw = [code.decode_bytes(ids) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), pa.array(raw, pa.binary())], ["key", "ids", "decoded"])

    return in_batches(df.select(F.col(key).alias("key"), "ids"), work, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def transcode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` and ``decoded`` in one pass: the ids of each whole text, and the bytes that these ids stand for."""
    kind = dict(df.dtypes)[key]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = encoding(rank_file, pattern)
        found, raw = [], []
        for text in texts_of(batch).to_pylist():
            ids = np.concatenate([code.encode_to_numpy(p) for p in parts(text)]) if text else np.empty(0, np.uint32)
            found.append(ids)
            raw.append(code.decode_bytes(ids.tolist()))
        starts = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([batch.column("key"), list_column(flat, starts, pa.int32()), pa.array(raw, pa.binary())], ["key", "ids", "decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return in_batches(rows, work, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def digests() -> list[Column]:
    """Lower-case SHA-256 of the decimal ids joined by commas, and of the decoded bytes."""
    return [F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def round_trip(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the bytes they decode to."""
    return transcode(df, rank_file, pattern, key).select(key, F.size("ids").cast("long").alias("n_tokens"), *digests())
