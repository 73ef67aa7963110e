"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of all orders and a uniform floor, with weights that depend on how
often the context was seen (powers of two). The weights are learned by expectation-maximisation on a deleted part:
training documents whose counts are left out of the estimates that the weights are fitted to. The final scores use the
counts of all training documents.

Counts never pass through the driver. The scan deals its texts out into blocks of about ``BLOCK_CHARS``; each block
sends its distinct n-grams, as sorted 64-bit hashes in packed rows, to buckets of the hash range. A bucket adds up the
blocks' counts and answers each block with the totals in the block's own order. The texts then meet the answers block by
block and are scored. What moves is a row per block and bucket, and one hash per distinct n-gram of a block, however often
it occurs; a very frequent n-gram is one number per block. Blocks and buckets are bounded, their number grows with the corpus;
beyond 2^``COARSE_BITS`` buckets the rows travel in two steps, so that they don't get ever smaller. Totals are 64-bit numbers.

The weights are fitted in ``ROUNDS`` steps to counts of (context bucket, estimates rounded to quarters of a natural logarithm);
the scores themselves use exact estimates. A context bucket that the deleted part lacks gets equal weights.

Block numbers follow the place of a row in its file, so that two scans agree; input that is not read from files is
written to the shared folder first. If the two scans disagree all the same the job fails rather than scores wrongly.

Tokens are the lower-cased (A-Z) words and one end per document; null and empty texts have the end only. Rows without
an id learn and are not held out. Repeated rows count and are scored row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import chained, findable, in_groups, mixed, slices, stored, texts_of, word_hashes, word_lists

BLOCK_CHARS = 8_000_000
#: Distinct n-grams of all blocks that one bucket holds, about.
BUCKET_ENTRIES = 1_500_000
END, START = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end")), np.uint64(xxhash.xxh3_64_intdigest(b"\x00start"))
HELD_OUT, DELETED, KEPT = 0, 1, 2
#: Steps per natural logarithm in the table that the weights are fitted to, and rounds of the fit.
STEPS, ROUNDS = 4, 50


class Totals(NamedTuple):
    tokens: int
    distinct: int
    documents: int


def _kind(key: str, parts: int = 10):
    rest = F.crc32(F.col(key).cast("string")) % parts
    return F.when(rest == 0, HELD_OUT).when(rest == 1, DELETED).otherwise(KEPT)


def _placed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, place, text); ``place`` names the stretch of a file that a row was read from."""
    def read(rows: DataFrame) -> DataFrame:
        place = F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start")
        return rows.select(F.col(key).alias("key"), _kind(key).alias("kind"), place.alias("place"), F.col(text).alias("text"))

    try:
        return read(df)
    except AnalysisException:
        return read(stored(df.select(key, text), "texts"))


def _dealt(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Block numbers and the rows of one batch that belong to them; rows of a block come one after another per kind."""
    filled: dict[tuple, list[int]] = {}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        places = batch.column("place").dictionary_encode()
        place_of, names = places.indices.to_numpy(zero_copy_only=False), places.dictionary.to_pylist()
        sizes = pc.binary_length(texts_of(batch)).to_numpy(zero_copy_only=False)
        number = np.zeros(batch.num_rows, np.uint64)
        for k in range(batch.num_rows):
            state = filled.setdefault((names[place_of[k]], int(kinds[k])), [0, 0])
            if state[1] and state[1] + sizes[k] > limit:
                state[0], state[1] = state[0] + 1, 0
            state[1] += int(sizes[k])
            number[k] = xxhash.xxh3_64_intdigest(f"{names[place_of[k]]}:{kinds[k]}:{state[0]}")
        for one in dict.fromkeys(number.tolist()):
            yield one, batch.filter(pa.array(number == np.uint64(one)))


def _ngrams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the key of the n-gram that ends at each token, and the index of each text's first token."""
    words, starts = word_lists(texts)
    hashes = word_hashes(words)
    n = len(starts) - 1
    lengths = np.diff(starts)
    width = lengths + order  # padding before, end after
    first = np.concatenate(([0], np.cumsum(width)))
    flat = np.full(first[-1], START, np.uint64)
    at = np.repeat(first[:-1] + order - 1 - starts[:-1], lengths) + np.arange(len(hashes))
    flat[at] = hashes
    flat[first[1:] - 1] = END
    real = np.ones(len(flat), bool)
    for k in range(order - 1):
        real[first[:-1] + k] = False
    keys = []
    for size in range(1, order + 1):
        grams = np.concatenate((np.zeros(size - 1, np.uint64), chained(flat, size))) if len(flat) >= size else np.zeros(len(flat), np.uint64)
        keys.append((mixed(grams[real]) & ~np.uint64(3)) | np.uint64(size))
    return keys, np.concatenate(([0], np.cumsum(lengths + 1)))[: n + 1]


def _pack(values: np.ndarray) -> bytes:
    """Byte planes: neighbours' equal high bytes lie side by side, which the shuffle's compression makes use of."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def block_rows(placed: DataFrame, order: int, bits: int, limit: int = BLOCK_CHARS) -> DataFrame:
    """(bucket, block, kind, grams, counts, documents, tokens): the distinct n-grams of each block, by bucket."""

    def rows(block: int, kind: int, parts: list[tuple[np.ndarray, np.ndarray]], documents: int, tokens: int) -> pa.RecordBatch:
        keys, counts = _summed(parts)
        edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, int)
        edges = np.concatenate(([0], edges, [len(keys)]))
        used = np.flatnonzero(np.diff(edges))
        columns = [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), np.uint64(block)).view(np.int64)),
            pa.array(np.full(len(used), kind), pa.int32()),
            pa.array([_pack(keys[edges[b] : edges[b + 1]]) for b in used], pa.binary()),
            pa.array([_pack(counts[edges[b] : edges[b + 1]]) if kind != HELD_OUT else b"" for b in used], pa.binary()),
            pa.array([documents] + [0] * (len(used) - 1), pa.int64()),
            pa.array([tokens] + [0] * (len(used) - 1), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "kind", "grams", "counts", "documents", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[tuple, list] = {}
        for block, batch in _dealt(_small(batches), limit):
            kind, place = batch.column("kind")[0].as_py(), batch.column("place")[0].as_py()
            known = open_blocks.get((place, kind))
            if known and known[0] != block:
                yield rows(known[0], kind, *known[1:])
                known = None
            for other in [x for x in open_blocks if x[0] != place]:  # the scan has left that stretch
                yield rows(open_blocks[other][0], other[1], *open_blocks.pop(other)[1:])
            keys, starts = _ngrams(texts_of(batch), order)
            part = np.unique(np.concatenate(keys), return_counts=True)
            known = known or [block, [], 0, 0]
            known[1] = [_summed([*known[1], (part[0], part[1].astype(np.uint32))])]
            known[2] += batch.num_rows
            known[3] += int(starts[-1])
            open_blocks[place, kind] = known
        for (_, kind), known in open_blocks.items():
            yield rows(known[0], kind, *known[1:])

    return placed.mapInArrow(run, "bucket int, block long, kind int, grams binary, counts binary, documents long, tokens long")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.uint32)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)


ANSWER = "block long, kind int, bucket int, size int, totals binary, kept binary, distinct long, distinct_kept long, tokens long, tokens_kept long, documents long, documents_kept long"
#: Bits of the hash that a block's rows are dealt by at once; more buckets than that take a second exchange.
COARSE_BITS = 10
#: Blocks that go through the second exchange together, about.
STRETCH_BLOCKS = 512
#: Tasks of one exchange at most.
MOST_PARTS = 1 << 16


def _totals(grams: list[np.ndarray], counts: list[np.ndarray], deleted: list[np.ndarray]) -> tuple[list[slice], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each list's n-grams are in ``inverse``, and the counts of all distinct n-grams in the whole and the deleted part."""
    keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    at = np.concatenate(([0], np.cumsum([len(g) for g in grams]))).tolist()
    total, left = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    for k in range(len(grams)):
        own = inverse[at[k] : at[k + 1]]
        np.add.at(total, own, counts[k])  # a list may hold a key of several blocks
        np.add.at(left, own, deleted[k])
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)], inverse, keys, total, left


def _distinct(keys: np.ndarray, total: np.ndarray, kept: np.ndarray) -> tuple[int, int]:
    single = (keys & np.uint64(3)) == 1
    return int((total[single] > 0).sum()), int((kept[single] > 0).sum())


def _parts(df: DataFrame, buckets: int) -> int:
    return min(buckets, MOST_PARTS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 16))


def answers(sent: DataFrame, bits: int, stretches: int = 1, coarse_bits: int = COARSE_BITS) -> DataFrame:
    """Per block and bucket the total counts in the order of the block's n-grams, and shares of the corpus totals.

    ``sent``: rows of 2^min(bits, coarse_bits) buckets. A bucket's rows meet in one task at a time. Where 2^bits is more than
    that, a row per block and bucket would hold next to nothing; then the rows of many blocks (a stretch) and a coarse bucket
    are first repacked into one row per fine bucket, answered, and unpacked again. So rows keep a useful size, and their
    number grows with stretches x buckets in place of blocks x buckets.
    """
    buckets, fine_bits = 1 << min(bits, coarse_bits), max(0, bits - coarse_bits)
    if not fine_bits:
        n = _parts(sent, buckets)
        return in_groups(sent, ["bucket"], ["block"], n, F.col("bucket") % n, _answer_blocks, ANSWER)
    wide, deep = _parts(sent, buckets * stretches), _parts(sent, buckets << fine_bits)

    def part(n: int, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    stretched = sent.withColumn("stretch", F.pmod(F.col("block"), F.lit(stretches)).cast("int"))
    by_stretch, by_fine = ["bucket", "stretch"], ["bucket", "fine"]
    repacked = in_groups(stretched, by_stretch, ["block"], wide, part(wide, *by_stretch), _repacker(fine_bits, coarse_bits), REPACKED)
    answered = in_groups(repacked, by_fine, ["stretch"], deep, part(deep, *by_fine), _answer_stretches, STRETCH_ANSWER)
    return in_groups(answered, by_stretch, ["fine"], wide, part(wide, *by_stretch), _unpack_stretch, ANSWER)


def _answer_blocks(rows: list[dict]) -> Iterator[dict]:
    grams = [_unpack(r["grams"], np.uint64) for r in rows]
    counts = [_unpack(r["counts"], np.uint32).astype(np.uint64) if r["kind"] != HELD_OUT else np.zeros(len(g), np.uint64) for r, g in zip(rows, grams, strict=True)]
    deleted = [c if r["kind"] == DELETED else np.zeros(len(c), np.uint64) for r, c in zip(rows, counts, strict=True)]
    places, inverse, keys, total, left = _totals(grams, counts, deleted)
    kept = total - left
    distinct = _distinct(keys, total, kept)
    for k, r in enumerate(rows):
        own, learns = inverse[places[k]], r["kind"] != HELD_OUT
        yield {
            "block": r["block"], "kind": r["kind"], "bucket": r["bucket"], "size": len(own), "totals": _pack(total[own]),
            "kept": _pack(kept[own]) if r["kind"] == DELETED else b"",
            "distinct": 0 if k else distinct[0], "distinct_kept": 0 if k else distinct[1],
            "tokens": r["tokens"] if learns else 0, "tokens_kept": r["tokens"] if r["kind"] == KEPT else 0,
            "documents": r["documents"] if learns else 0, "documents_kept": r["documents"] if r["kind"] == KEPT else 0,
        }


#: One row per coarse bucket, stretch and fine bucket: the stretch's blocks that have n-grams there, how many, and these.
REPACKED = "bucket int, stretch int, fine int, blocks binary, kinds binary, sizes binary, grams binary, counts binary, tokens binary, documents binary"
STRETCH_ANSWER = "bucket int, stretch int, fine int, blocks binary, kinds binary, sizes binary, totals binary, kept binary, distinct long, distinct_kept long, tokens binary, documents binary"


def _repacker(fine_bits: int, coarse_bits: int) -> Callable[[list[dict]], Iterator[dict]]:
    def work(rows: list[dict]) -> Iterator[dict]:
        found: dict[int, list[tuple]] = {}
        for r in rows:
            grams = _unpack(r["grams"], np.uint64)
            counts = _unpack(r["counts"], np.uint32) if r["kind"] != HELD_OUT else np.zeros(len(grams), np.uint32)
            fine = (grams << np.uint64(coarse_bits)) >> np.uint64(64 - fine_bits)
            cuts = [0, *(np.flatnonzero(np.diff(fine)) + 1).tolist(), len(grams)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                once = (r["tokens"], r["documents"]) if k == 0 else (0, 0)
                found.setdefault(int(fine[a]), []).append((r["block"], r["kind"], b - a, grams[a:b], counts[a:b], *once))
        for fine, pieces in sorted(found.items()):
            blocks, kinds, sizes, grams, counts, tokens, documents = zip(*pieces, strict=True)
            yield {
                "bucket": rows[0]["bucket"], "stretch": rows[0]["stretch"], "fine": fine,
                "blocks": _pack(np.array(blocks, np.int64)), "kinds": _pack(np.array(kinds, np.int32)), "sizes": _pack(np.array(sizes, np.int64)),
                "grams": _pack(np.concatenate(grams)), "counts": _pack(np.concatenate(counts)),
                "tokens": _pack(np.array(tokens, np.int64)), "documents": _pack(np.array(documents, np.int64)),
            }

    return work


def _answer_stretches(rows: list[dict]) -> Iterator[dict]:
    grams = [_unpack(r["grams"], np.uint64) for r in rows]
    counts = [_unpack(r["counts"], np.uint32).astype(np.uint64) for r in rows]
    is_deleted = [np.repeat(_unpack(r["kinds"], np.int32) == DELETED, _unpack(r["sizes"], np.int64)) for r in rows]
    places, inverse, keys, total, left = _totals(grams, counts, [np.where(d, c, np.uint64(0)) for c, d in zip(counts, is_deleted, strict=True)])
    kept = total - left
    distinct = _distinct(keys, total, kept)
    for k, r in enumerate(rows):
        own = inverse[places[k]]
        yield {c: r[c] for c in ("bucket", "stretch", "fine", "blocks", "kinds", "sizes", "tokens", "documents")} | {
            "totals": _pack(total[own]), "kept": _pack(kept[own]), "distinct": 0 if k else distinct[0], "distinct_kept": 0 if k else distinct[1],
        }


def _unpack_stretch(rows: list[dict]) -> Iterator[dict]:
    """The answers of a stretch's blocks for one coarse bucket, its fine buckets put together in order."""
    found: dict[int, list] = {}
    for r in rows:
        totals, kept = _unpack(r["totals"], np.uint64), _unpack(r["kept"], np.uint64)
        columns = [_unpack(r[c], t).tolist() for c, t in (("blocks", np.int64), ("kinds", np.int32), ("sizes", np.int64), ("tokens", np.int64), ("documents", np.int64))]
        at = 0
        for block, kind, size, tokens, documents in zip(*columns, strict=True):
            known = found.setdefault(block, [kind, [], [], 0, 0])
            known[1].append(totals[at : at + size])
            known[2].append(kept[at : at + size])
            known[3], known[4], at = known[3] + tokens, known[4] + documents, at + size
    first = {"distinct": sum(r["distinct"] for r in rows), "distinct_kept": sum(r["distinct_kept"] for r in rows)}
    for k, (block, (kind, totals, kept, tokens, documents)) in enumerate(found.items()):
        whole, learns = np.concatenate(totals), kind != HELD_OUT
        yield {
            "block": block, "kind": kind, "bucket": rows[0]["bucket"], "size": len(whole), "totals": _pack(whole),
            "kept": _pack(np.concatenate(kept)) if kind == DELETED else b"",
            "distinct": 0 if k else first["distinct"], "distinct_kept": 0 if k else first["distinct_kept"],
            "tokens": tokens if learns else 0, "tokens_kept": tokens if kind == KEPT else 0,
            "documents": documents if learns else 0, "documents_kept": documents if kind == KEPT else 0,
        }


def _events(texts: pa.Array, table: pa.Table, column: str, order: int, documents: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per order the count of the n-gram at each token and of its context, from a block's texts and its answers."""
    keys, starts = _ngrams(texts, order)
    own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    table = table.sort_by("bucket")
    counts = np.concatenate([_unpack(x, np.uint64) for x in table[column].to_pylist()]) if table.num_rows else np.empty(0, np.uint64)
    if len(counts) != len(own):
        raise RuntimeError(f"A block was dealt differently by two scans of the input: {len(own)} and {len(counts)} n-grams.")
    per = np.split(counts[inverse].astype(np.int64), order)
    contexts = []
    for level in range(1, order):
        before = np.concatenate(([documents], per[level - 1][:-1]))
        before[starts[:-1]] = documents
        contexts.append(before)
    return per, contexts, starts


def _mixture(per: list[np.ndarray], contexts: list[np.ndarray], totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token's contexts, and its estimates by order: uniform, unigram, and so on."""
    bucket = np.zeros(len(per[0]), np.int64)
    shares = [np.full(len(per[0]), 1 / (totals.distinct + 1)), per[0] / max(totals.tokens, 1)]
    for count, context in zip(per[1:], contexts, strict=True):
        bucket = bucket * 64 + np.ceil(np.log2(context + 1.0)).astype(np.int64)
        shares.append(count / np.maximum(context, 1))
    return bucket, np.stack(shares)


def fit_weights(cells: list[tuple], order: int, rounds: int = ROUNDS) -> dict[int, list[float]]:
    """``cells``: (bucket, steps of each estimate but the uniform one, uniform, number of tokens)."""
    weights = {}
    for bucket in sorted({c[0] for c in cells}):
        own = [c for c in cells if c[0] == bucket]
        n = np.array([c[-1] for c in own], float)
        steps = np.array([c[1] for c in own], float).reshape(len(own), order)
        shares = np.vstack([np.array([c[2] for c in own])[None], np.where(steps > 0, 0, np.exp(steps / STEPS)).T])
        mix = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            part = mix[:, None] * shares
            mix = (part / part.sum(0) * n).sum(1) / n.sum()
        mix = np.maximum(mix, 1e-5)
        weights[int(bucket)] = (mix / mix.sum()).tolist()
    return weights


def scored(df: DataFrame, order: int = 2, key: str = "doc_id", text: str = "text", add: float = 0.1, block_chars: int = BLOCK_CHARS, bucket_entries: int = BUCKET_ENTRIES, coarse_bits: int = COARSE_BITS) -> DataFrame:
    """Per row: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score, both as log10 of probabilities."""
    kind = dict(df.dtypes)[key]
    findable(df.sparkSession)
    placed = _placed(df, key, text)
    chars = placed.agg(F.sum(F.char_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, chars / 6 * (order - 1 + 0.3) / bucket_entries)))))
    sent = block_rows(placed, order, min(bits, coarse_bits), block_chars)
    got = stored(answers(sent, bits, 1 + chars // block_chars // STRETCH_BLOCKS, coarse_bits), "counts")
    sums = got.agg(*[F.sum(c).alias(c) for c in ("distinct", "distinct_kept", "tokens", "tokens_kept", "documents", "documents_kept")]).first()
    full = Totals(*[int(sums[c] or 0) for c in ("tokens", "distinct", "documents")])
    kept = Totals(*[int(sums[f"{c}_kept"] or 0) for c in ("tokens", "distinct", "documents")])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _dealt(_small(batches), block_chars):
            column = pa.array(np.full(batch.num_rows, np.uint64(block)).view(np.int64))
            yield pa.RecordBatch.from_arrays([column, batch.column("kind"), batch.column("key"), batch.column("text")], ["block", "kind", "key", "text"])

    texts = placed.mapInArrow(number, f"block long, kind int, key {kind}, text string")

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        per, contexts, _ = _events(_whole(left), right, "kept", order, kept.documents)
        bucket, shares = _mixture(per, contexts, kept)
        steps = np.where(shares[1:] > 0, np.round(np.log(np.maximum(shares[1:], 1e-300)) * STEPS), 1).astype(np.int64)
        cell = np.concatenate((bucket[None], steps)).T
        unique, n = np.unique(cell, axis=0, return_counts=True)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(unique[:, 1:].reshape(-1)), order).cast(pa.list_(pa.int64()))
        return pa.table([pa.array(unique[:, 0]), lists, pa.array(n, pa.int64())], ["context", "steps", "n"])

    deleted = got.where(F.col("kind") == DELETED).select("block", "bucket", "kept")
    counted = texts.where(F.col("kind") == DELETED).groupBy("block").cogroup(deleted.groupBy("block")).applyInArrow(cells, "context long, steps array<bigint>, n long")
    found = counted.groupBy("context", "steps").agg(F.sum("n").alias("n")).collect()  # at most 64 contexts per order times the steps
    weights = fit_weights([(r["context"], r["steps"], 1 / (kept.distinct + 1), r["n"]) for r in found], order)
    even = [1 / (order + 1)] * (order + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        per, contexts, starts = _events(_whole(left), right, "totals", order, full.documents)
        bucket, shares = _mixture(per, contexts, full)
        names, index = np.unique(bucket, return_inverse=True)
        mix = np.array([weights.get(int(b), even) for b in names]).T
        model = np.log10((mix[:, index] * shares).sum(0))
        base = np.log10((per[0] + add) / (full.tokens + add * (full.distinct + 1)))
        add_up = lambda x: np.add.reduceat(x, starts[:-1])
        columns = [left["key"], left["kind"], pa.array(np.diff(starts)), pa.array(add_up((per[0] > 0).astype(np.int64))), pa.array(add_up(base)), pa.array(add_up(model))]
        return pa.table(columns, ["key", "kind", "n_tokens", "n_known", "base_score", "score"])

    answered = got.select("block", "bucket", "totals")
    out = texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, f"key {kind}, kind int, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias(key), (F.col("kind") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(full.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _whole(table: pa.Table) -> pa.Array:
    texts = table["text"].cast(pa.large_string()).combine_chunks()
    return pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
