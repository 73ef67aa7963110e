"""Language identification by averaged embeddings of hashed subwords and a linear softmax.

A word is a run of letters, lower-cased and put between ``<`` and ``>``; its 2- to 4-grams are hashed into ``BUCKETS``
embeddings. A text is the mean of the embeddings of all its n-grams, a linear layer and a softmax over the languages follow.
Embeddings and layer are trained together by stochastic gradient descent in numpy, on whole documents and on excerpts of a
few words, from a sample of at most ``MAX_DOCUMENTS`` labelled rows that is spread evenly over the languages. A fifth of the
sample calibrates: it fits how sharp the softmax should be for a given number of n-grams, and the score below which a
prediction counts as rejected (precision ``PRECISION`` above it; never under one half).

After training only the product of embeddings and layer is kept, as whole numbers, so sums don't depend on how rows are
batched. Each distinct word of a batch is looked up once; texts are read in one narrow pass and never shuffled.

A null text and a text without a letter are ``und`` with score 0, rejected; so is every text where no labelled row was
learned from. Letters of an unknown script give a learned language with a low score. Rows without an id learn and are not
held out; repeated rows are predicted row by row. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import chained, in_batches, mixed, texts_of

BUCKETS, SIZES, DIMENSION = 1 << 15, (2, 3, 4), 16
#: Labelled rows that the fit sees at most, over all languages; words of the excerpts taken from each of them.
MAX_DOCUMENTS, EXCERPTS = 2000, (1, 3, 8, 24)
ROUNDS, RATE = 5, 0.5
PRECISION = 0.99
#: A weight of 1 in the kept table.
UNIT = 1 << 16
#: Code points whose n-grams are looked up at once.
STRETCH = 1 << 18
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    #: (BUCKETS, languages), in units of 1 / UNIT
    table: np.ndarray
    bias: np.ndarray
    #: The softmax is sharpened by exp(sharp + slope * ln(n-grams)).
    sharp: float
    slope: float
    threshold: float


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The letter runs of each text, lower-cased, and where each text's runs begin."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return words.filter(real), before[offsets - offsets[0]].astype(np.int64)


def ngrams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, bucket) of every n-gram of the words, a stretch at a time."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    for a in range(0, len(codes), STRETCH):
        hashes = mixed(codes[a : a + STRETCH + max(SIZES) - 1].astype(np.uint64) + np.uint64(1))
        n = min(STRETCH, len(codes) - a)
        owner = np.searchsorted(ends, np.arange(a, a + n), side="right")
        left = ends[owner] - np.arange(a, a + n)
        for size in SIZES:
            ids = (chained(hashes, size)[:n] % np.uint64(BUCKETS)).astype(np.int64)
            inside = left[: len(ids)] >= size
            yield owner[: len(ids)][inside], ids[inside]


def example(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for _, ids in ngrams(words):
        counts += np.bincount(ids, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def examples(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_DOCUMENTS) -> DataFrame:
    """(pick, lang, calibrates, size, buckets, counts) of the sampled documents and of their excerpts."""
    own = docs.where(~held_out(key) & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    quota = max(1, most // max(len(sizes), 1))
    pick = F.xxhash64("key", "text")
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, quota / n)))]) if sizes else F.lit(None)
    taken = own.withColumn("pick", pick).where((F.pmod("pick", F.lit(1 << 20)) / float(1 << 20)) < (F.try_element_at(share, F.col("lang")) if sizes else F.lit(0.0)))
    taken = taken.dropDuplicates(["pick"]).select("pick", "lang", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, starts = letter_words(texts_of(batch))
        rows = []
        for k, (p, name) in enumerate(zip(batch.column("pick").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
            own = words.slice(starts[k], starts[k + 1] - starts[k]).to_pylist()
            for size in (*[s for s in EXCERPTS if s < len(own)], *([len(own)] if own else [])):
                at = (p >> 20) % (len(own) - size + 1)
                used, counts = example(own[at : at + size])
                rows.append({"pick": p, "lang": name, "calibrates": (p >> 8) % 5 == 0, "size": size, "buckets": used, "counts": counts})
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("pick", pa.int64()), ("lang", pa.string()), ("calibrates", pa.bool_()), ("size", pa.int64()), ("buckets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    return in_batches(taken, work, "pick long, lang string, calibrates boolean, size long, buckets array<long>, counts array<long>")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_DOCUMENTS) -> Model:
    """A model of the languages in the rows that are not held out."""
    found = examples(docs, key, text, lang, most).orderBy("pick", "size").limit(2 * most * (len(EXCERPTS) + 1)).collect()
    langs = sorted({r["lang"] for r in found})
    rows = [(np.array(r["buckets"]), np.array(r["counts"], float), langs.index(r["lang"]), r["calibrates"]) for r in found]
    learned = [r for r in rows if not r[3]] or rows
    table, bias = trained(learned, len(langs))
    checks = [r for r in rows if r[3]] or rows
    logits = np.array([table[ids].T @ counts / counts.sum() / UNIT + bias for ids, counts, *_ in checks]).reshape(len(checks), len(langs))
    sharp, slope, threshold = calibrated(logits, np.array([r[1].sum() for r in checks]), np.array([r[2] for r in checks], int))
    return Model(langs, table, bias, sharp, slope, threshold)


def trained(rows: list[tuple], n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The product of embeddings and layer, in units of 1 / UNIT, and the bias; buckets that no row has stay 0."""
    rng = np.random.default_rng(seed)
    embedding, layer, bias = rng.normal(0, 1 / DIMENSION, (BUCKETS, DIMENSION)), rng.normal(0, 1, (n, DIMENSION)), np.zeros(n)
    steps, seen = np.full(BUCKETS, 1e-8), np.zeros(BUCKETS, bool)
    layer_steps = np.full((n, 1), 1e-8)
    for ids, *_ in rows:
        seen[ids] = True
    for _ in range(ROUNDS):
        for k in rng.permutation(len(rows)):
            ids, counts, label, _ = rows[k]
            share = counts / counts.sum()
            mean = share @ embedding[ids]
            wrong = _softmax(layer @ mean + bias)
            wrong[label] -= 1
            back = layer.T @ wrong
            layer_steps += (wrong**2 * (mean @ mean))[:, None]
            layer -= RATE * np.outer(wrong, mean) / np.sqrt(layer_steps)
            bias -= 0.01 * wrong
            steps[ids] += share**2 * (back @ back)
            embedding[ids] -= (RATE * share / np.sqrt(steps[ids]))[:, None] * back
    embedding[~seen] = 0
    return np.round(embedding @ layer.T * UNIT).astype(np.int32), bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def calibrated(logits: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Sharpness and slope of the least log loss on the given rows, and the threshold that keeps ``PRECISION``."""
    if not len(labels):
        return 0.0, 0.0, 0.5
    tried = []
    for sharp in np.arange(-3, 4.01, 0.25):
        for slope in np.arange(0, 0.61, 0.1):
            p = _softmax(logits * np.exp(sharp + slope * np.log(sizes))[:, None])
            tried.append((float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()), float(sharp), float(slope)))
    _, sharp, slope = min(tried)
    p = _softmax(logits * np.exp(sharp + slope * np.log(sizes))[:, None])
    top, right = p.max(1), p.argmax(1) == labels
    order = np.argsort(-top, kind="stable")
    last = np.append(np.diff(top[order]) != 0, True)  # equal scores are accepted together
    good = last & (np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    threshold = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return sharp, slope, max(threshold, 0.5)


def predict(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The language number of each text (-1: none) and its score."""
    words, starts = letter_words(texts)
    n, used = len(texts), len(words) > 0 and len(model.langs) > 0
    best, score = np.full(n, -1), np.zeros(n)
    if not used:
        return best, score
    coded = words.dictionary_encode()
    sums = np.zeros((len(model.langs), len(coded.dictionary)))
    sizes = np.zeros(len(coded.dictionary))
    for owner, ids in ngrams(coded.dictionary.to_pylist()):
        sizes += np.bincount(owner, minlength=len(sizes))
        for k in range(len(model.langs)):
            sums[k] += np.bincount(owner, weights=model.table[ids, k], minlength=len(sizes))  # whole numbers below 2^53: exact
    places = coded.indices.to_numpy(zero_copy_only=False)

    def per_text(values: np.ndarray) -> np.ndarray:
        before = np.concatenate(([0], np.cumsum(values[places].astype(np.int64))))
        return (before[starts[1:]] - before[starts[:-1]]).astype(float)

    total = per_text(sizes)
    some = total > 0
    logits = np.stack([per_text(s) for s in sums], 1)[some] / total[some, None] / UNIT + model.bias
    p = _softmax(logits * np.exp(model.sharp + model.slope * np.log(total[some]))[:, None])
    best[some], score[some] = p.argmax(1), p.max(1)
    return best, score


def judged(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, held_out, lang_pred, score, rejected (null and letterless texts are)."""
    kind = dict(docs.dtypes)[key]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score = predict(texts_of(batch), model)
        names = pa.array([model.langs[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string())
        columns = [batch.column("key"), batch.column("held_out"), names, pa.array(score), pa.array((best < 0) | (score < model.threshold))]
        return pa.RecordBatch.from_arrays(columns, ["key", "held_out", "lang_pred", "score", "rejected"])

    own = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    out = in_batches(own, work, f"key {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("key", key)
