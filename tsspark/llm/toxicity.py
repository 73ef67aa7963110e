"""Toxicity of texts that hide their words: noisy-channel restoration, then a linear score.

Writers hide words by look-alike characters (1d10t), by spacing or dots (i d i o t, i.d.i.o.t) and by repetition
(idiooot). Every suspicious word, and every run of three or more single characters, becomes a lattice of letters that
each character may stand for, may drop, or may break at. A character trigram model, counted over the words of all
documents, weighs the paths, and a Viterbi search takes the cheapest, over the whole word or run however long: its cost is
linear in the length. Plain words are their own restoration.

The score is a logistic regression on the distinct restored words and their first four letters, hashed to a fixed
number of places. It is fitted by one task on at most ``MAX_LABELLED`` labelled rows, chosen by a hash of the id; the
penalty keeps few weights, and these go to the scoring tasks (at most ``PLACES`` numbers). Scoring is one narrow pass over
whole texts.

Null and empty texts have no words and get the model's base rate. Labels without a row, rows without a label and null
labels take no part in the fit; with no labels at all every score is 0. Repeated rows are scored row by row.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import in_batches, texts_of, word_hashes, word_lists

PLACES = 1 << 20
#: Labelled rows that the fit may use.
MAX_LABELLED = 20_000
SCREEN = 2.5
LETTERS = 28  # word end, a-z, any other letter

#: Characters and the letters they often stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
EDGES = ".,;:!?\"'`()[]{}<>#*$%&|~^_=+/\\-"
BETWEEN = " .-_*~'`,:;/\\#%&^="
#: Costs of the channel, as negative log probabilities.
LOOK, DROP, BREAK, REPEAT, STAY = 0.7, 0.4, 2.0, 0.6, 7.0
_SUSPECT = r"\pL[^\pL\s]+\pL|^[0-9@$!|+€(£]\pL|\pL[0-9@$]|^[0-9@$!|+]{3,}$|aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz"
#: Readings of longer stretches are not remembered; they hardly come again.
MAX_REMEMBERED = 200


def _code(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27


class CharModel:
    """Interpolated character trigrams over a-z, one class for other letters, and the word end."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + LETTERS)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.cost = -np.log(p3)
        self.seen: dict[str, str] = {}

    def restore(self, raw: str) -> str:
        """The cheapest reading of ``raw`` (lower case); blanks in the answer are word breaks."""
        if len(raw) > MAX_REMEMBERED:
            return self._viterbi(raw)
        if raw not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            self.seen[raw] = self._viterbi(raw)
        return self.seen[raw]

    def _viterbi(self, raw: str) -> str:
        return self.search(raw)[1]

    def search(self, raw: str) -> tuple[float, str]:
        """The least cost of all readings, and the first reading that has it.

        A state is the classes of the last two letters and the last character, which bounds their number; each has its
        reading as (reading before, letter), so the search is linear in the length.
        """
        paths: dict[tuple, tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for k, char in enumerate(raw):
            nxt: dict[tuple, tuple[float, tuple | None]] = {}

            def offer(state, cost, out, nxt=nxt):
                if state not in nxt or cost < nxt[state][0]:
                    nxt[state] = (cost, out)

            again = k > 0 and raw[k - 1] == char
            for (p, q, last), (cost, out) in paths.items():
                if char.isalpha():
                    options = [(char, 0.0)]
                else:
                    options = [(x, LOOK) for x in LOOKS.get(char, "")]
                    if char in BETWEEN or char in EDGES:
                        offer((p, q, last), cost + DROP, out)
                    if char in BETWEEN and q:
                        offer((q, 0, ""), cost + BREAK + self.cost[p, q, 0], (out, " "))
                    if char not in BETWEEN:
                        options.append((char, STAY))
                for letter, extra in options:
                    c = _code(letter)
                    offer((q, c, letter), cost + extra + self.cost[p, q, c], (out, letter))
                if again and last and (char == last or last in LOOKS.get(char, "")):
                    offer((p, q, last), cost + REPEAT, out)
            paths = nxt
        ends = [(cost + self.cost[p, q, 0], out) for (p, q, _), (cost, out) in paths.items()]
        least = min((cost for cost, _ in ends), default=0.0)
        return least, min((_written(out) for cost, out in ends if cost == least), default=raw)


def _written(out: tuple | None) -> str:
    letters = []
    while out is not None:
        out, letter = out
        letters.append(letter)
    return "".join(reversed(letters))


class Model(NamedTuple):
    chars: np.ndarray
    weights: np.ndarray
    bias: float


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    words, starts = word_lists(texts, lower=False)
    return words, starts


def _trigrams(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, _ = _words(texts_of(batch))
    counts = np.zeros(LETTERS**3, np.int64)
    if len(words):
        coded = words.dictionary_encode()
        plain = pc.utf8_lower(pc.utf8_trim(coded.dictionary, EDGES))
        real = pc.match_substring_regex(plain, r"^\pL+$").to_numpy(zero_copy_only=False)
        many = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(plain))[real]
        kept = plain.filter(pa.array(real)).to_pylist()
        points = np.frombuffer(("\0\0" + "\0\0".join(kept) + "\0\0").encode("utf-32-le"), np.uint32)
        codes = np.where(points == 0, 0, np.where((points >= 97) & (points <= 122), points - 96, 27)).astype(np.int64)
        owner = np.cumsum(np.concatenate(([0], (codes[1:] != 0) & (codes[:-1] == 0)))) - 1
        key = (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]
        ends = (codes[1:-1] == 0) & (codes[2:] == 0)  # the gap between words, not a word's end
        wanted = ~ends & (owner[2:] >= 0)
        counts = np.bincount(key[wanted], weights=many[owner[2:]][wanted] if len(many) else None, minlength=LETTERS**3).astype(np.int64)
    used = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["gram", "n"])


def char_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Character trigram counts over the words of all texts; at most 28 ** 3 sums reach the driver."""
    rows = in_batches(df.select(F.col(text).alias("text")), _trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LETTERS**3)
    for row in rows:
        counts[row["gram"]] = row["n"]
    return counts


def _heads(words: pa.Array) -> pa.Array:
    text = pa.large_string()
    return pc.binary_join_element_wise(pa.scalar("^", text), pc.utf8_slice_codeunits(words, 0, 4), pa.scalar("", text))


def features(texts: pa.Array, model: CharModel) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the restored words and of their first four letters, with repetitions."""
    words, starts = _words(texts)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    coded = words.dictionary_encode()
    index, table = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    lowered = pc.utf8_lower(table)
    plain = pc.utf8_trim(lowered, EDGES)
    # look-alikes at the ends of a word belong to it, unless they are a longer run of marks
    ends = pc.replace_substring_regex(lowered, r"[^\pL\d$@!|+]+$|^[^\pL\d$@!|+(]+|[$!|+]{3,}$|[!|.,;:?+]+$", "")
    odd = pc.indices_nonzero(pc.match_substring_regex(ends, _SUSPECT)).to_numpy()
    extra_rows, extra_words = [], []
    if len(odd):
        restored = {}
        for k in odd.tolist():
            restored[k] = model.restore(ends[k].as_py()).split(" ")
        at = np.flatnonzero(np.isin(index, list(restored)))
        for i in at.tolist():
            for word in restored[index[i]]:
                extra_rows.append(rows[i])
                extra_words.append(word)
    # a letter with marks at its ends is a single one too
    bare = pc.if_else(pc.equal(pc.utf8_length(table), 1), lowered, plain)
    single = (pc.utf8_length(bare).to_numpy() == 1)[index]
    if single.any():
        fresh = np.concatenate(([True], (rows[1:] != rows[:-1]) | ~single[:-1] | ~single[1:]))
        begin = np.flatnonzero(fresh)
        length = np.diff(np.concatenate((begin, [len(single)])))
        for b, n in zip(begin.tolist(), length.tolist(), strict=True):
            if n >= 3 and single[b]:
                raw = " ".join(bare[int(j)].as_py() for j in index[b : b + n])
                for word in model.restore(raw).split(" "):
                    extra_rows.append(rows[b])
                    extra_words.append(word)
    whole, heads = word_hashes(plain), word_hashes(_heads(plain))
    out_rows, out = [rows, rows], [whole[index], heads[index]]
    if extra_words:
        more = pa.array(extra_words, pa.large_string())
        out_rows += [np.array(extra_rows)] * 2
        out += [word_hashes(more), word_hashes(_heads(more))]
    return np.concatenate(out_rows), (np.concatenate(out) % np.uint64(PLACES)).astype(np.int64)


def _fit(rows: np.ndarray, places: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 1e-5, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features with an L1 penalty: full-batch proximal AdaGrad.

    Weights are kept at 0 or above: a word speaks for toxicity or not at all, and plain words can't buy a bad one off.
    Features whose labels differ from the average by less than ``SCREEN`` standard errors are left out first.
    """
    used, compact = np.unique(places, return_inverse=True)
    held, toxic = np.bincount(compact, minlength=len(used)), np.bincount(compact, weights=y[rows], minlength=len(used))
    spread = np.sqrt(np.maximum(held * y.mean() * (1 - y.mean()), 1e-12))
    telling = (held >= 2) & (np.abs(toxic - held * y.mean()) >= SCREEN * spread)
    kept = telling[compact]
    rows, compact = rows[kept], compact[kept]
    w, squares, n = np.zeros(len(used)), np.full(len(used), 1e-12), len(y)
    share = min(max(y.mean(), 1 / (n + 2)), 1 - 1 / (n + 2))
    b = base = math.log(share / (1 - share))
    b_squares = 1e-12
    for _ in range(rounds if 0 < y.mean() < 1 else 0):
        z = b + np.bincount(rows, weights=w[compact], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(compact, weights=error[rows], minlength=len(used)) / n
        squares += grad * grad
        step = rate / np.sqrt(squares)
        w = w - step * grad
        w = np.maximum(w - step * penalty, 0)
        b_squares += error.mean() ** 2
        b -= 0.1 * rate / math.sqrt(b_squares) * error.mean()
    full = np.zeros(PLACES)
    full[used] = w
    return full, b if 0 < y.mean() < 1 else base


def train(documents: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_LABELLED) -> Model:
    """``may_learn``: condition on the id; rows beyond it lend no label. Character counts come from all documents."""
    counts = char_counts(documents, text)
    usable = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)")
    usable = usable.where(may_learn).groupBy("key").agg(F.max("y").alias("y"))
    n = usable.count()
    if n > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * 0.97 * max_rows / n))
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(usable), "key")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = CharModel(counts)
        at, place = features(texts_of(batch), model)
        pair = np.unique(at * PLACES + place)
        starts = np.searchsorted(pair // PLACES, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pair % PLACES, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("y"), lists], ["key", "y", "places"])

    def fit(batches):
        full = [b for b in batches if b.num_rows]
        if full:
            table = pa.Table.from_batches(full).sort_by([("key", "ascending")])
            lists = table["places"].combine_chunks()
            lengths = pc.list_value_length(lists).to_numpy()
            w, b = _fit(np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(), table["y"].to_numpy())
            some = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(w[some], b), pa.float64())], ["place", "weight"])

    extracted = in_batches(rows.select("key", "y", "text"), extract, "key string, y int, places array<int>")
    found = extracted.repartition(1).mapInArrow(fit, "place int, weight double").collect()
    weights, bias = np.zeros(PLACES), -math.inf
    for row in found:
        if row["place"] < 0:
            bias = row["weight"]
        else:
            weights[row["place"]] = row["weight"]
    return Model(counts, weights, bias)


def _scores(texts: pa.Array, chars: CharModel, model: Model) -> np.ndarray:
    if model.bias == -math.inf:
        return np.zeros(len(texts))
    at, place = features(texts, chars)
    heavy = model.weights[place] != 0
    pair = np.unique(at[heavy] * PLACES + place[heavy])
    z = model.bias + np.bincount(pair // PLACES, weights=model.weights[pair % PLACES], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def with_scores(df: DataFrame, model: Model, text: str = "text", column: str = "toxicity", least: float | None = None) -> DataFrame:
    """The rows, all columns, and their score; with ``least`` only rows that score below it, without the score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    state: dict[str, CharModel] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "chars" not in state:
            state["chars"] = CharModel(shared.value.chars)
        scores = _scores(texts_of(batch, text), state["chars"], shared.value)
        if least is not None:
            return batch.filter(pa.array(scores < least))
        return batch.append_column(column, pa.array(scores, pa.float64()))

    schema = df.schema if least is not None else df.withColumn(column, F.lit(0.0)).schema
    return in_batches(df, work, schema)


def learnable(key: str = "key", parts: int = 5) -> Column:
    """Ids whose CRC leaves a remainder: the others are held out."""
    return F.crc32(F.col(key).cast("string")) % parts != 0


def judged(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, held_out, score, predicted (1 from a score of 0.5 on)."""
    model = train(documents, labels, learnable(), key, text)
    rows = with_scores(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), model, column="score")
    held = ~F.coalesce(learnable(), F.lit(True))
    return rows.select(F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, that score below 0.5."""
    return with_scores(documents, train(documents, labels, learnable(), key, text), text, least=0.5)
