import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tsspark.llm import toxicity
from tsspark.llm.catalog import QUERIES

BAD = ["idiot", "moron", "scum", "loser"]
HIDDEN = ["1d10t", "m0r0n", "$cum", "l o s e r", "idiooot", "m.o.r.o.n", "l0ser"]


def rest(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def world(spark):
    """Documents that are toxic if they hold a bad word; in the held-out fifth it is hidden."""
    rng = random.Random(8)
    clean = [a + b for a in ("the", "on", "er", "ti", "sh", "ea") for b in ("", "nd", "st", "re", "ou", "ing")]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.4)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(HIDDEN if rest(i) == 0 else BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (1002, rows[5][1])]
    labels += [(5000, 0, 1), (None, 1, 1), (1000, 1, None)]
    documents = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(rows), {i: t for i, _, t in labels}


def test_held_out_accuracy(world, tables, spark):
    documents, labels, texts, truth = world
    got = QUERIES["op8_toxicity"](spark, tables(documents=documents, labels=labels)).collect()
    assert len(got) == 604
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (rest(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [i for i in range(600) if rest(i) == 0]
    right = sum(by_id[i]["predicted"] == truth[i] for i in held)
    assert right >= 0.95 * len(held)
    assert by_id[1000]["score"] == by_id[1001]["score"] < 0.5


def test_stage_keeps_clean_documents(world):
    documents, labels, _, truth = world
    kept = toxicity.drop_toxic(documents, labels)
    assert kept.columns == documents.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    train = [i for i in range(600) if rest(i)]
    assert all((i in ids) == (truth[i] == 0) for i in train) and {1000, 1001} <= ids


def test_labels_of_held_out_rows_are_not_used(world, spark):
    documents, labels, _, _ = world
    flipped = labels.withColumn("toxic", toxicity.F.when(~toxicity.learnable("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (toxicity.train(documents, x, toxicity.learnable()) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


@pytest.fixture(scope="module")
def chars(world):
    return toxicity.CharModel(toxicity.char_counts(world[0]))


@pytest.mark.parametrize("raw, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("l o s e r", "loser"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("l0$er", "loser")])
def test_restoration(chars, raw, word):
    assert chars.restore(raw) == word


def brute(model, raw):
    """All readings of a short word, each priced like a path."""
    best = (float("inf"), "")

    def walk(k, p, q, last, cost, out):
        nonlocal best
        if k == len(raw):
            best = min(best, (cost + model.cost[p, q, 0], out))
            return
        c = raw[k]
        options = [(c, 0.0)] if c.isalpha() else [(x, toxicity.LOOK) for x in toxicity.LOOKS.get(c, "")]
        if not c.isalpha():
            if c in toxicity.BETWEEN or c in toxicity.EDGES:
                walk(k + 1, p, q, last, cost + toxicity.DROP, out)
            if c in toxicity.BETWEEN and q:
                walk(k + 1, q, 0, "", cost + toxicity.BREAK + model.cost[p, q, 0], out + " ")
            if c not in toxicity.BETWEEN:
                options.append((c, toxicity.STAY))
        for x, extra in options:
            n = toxicity._code(x)
            walk(k + 1, q, n, x, cost + extra + model.cost[p, q, n], out + x)
        if k and raw[k - 1] == c and last and (c == last or last in toxicity.LOOKS.get(c, "")):
            walk(k + 1, p, q, last, cost + toxicity.REPEAT, out)

    walk(0, 0, 0, "", 0.0, "")
    return best[1]


def test_viterbi_finds_the_cheapest_reading(chars):
    rng = random.Random(3)
    for _ in range(200):
        raw = "".join(rng.choice("aet1103$.oo-") for _ in range(rng.randint(1, 7)))
        assert chars.restore(raw) == brute(chars, raw), raw


def test_empty_tables_clashing_names_and_no_labels(clashing, documents, world, spark):
    none = spark.createDataFrame([], world[1].schema)
    assert toxicity.judged(documents([]), none).count() == 0
    rows = toxicity.judged(clashing([(1, "a"), (None, None)]), none).collect()
    assert [(r["score"], r["predicted"]) for r in rows] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(1, 1, 1)], world[1].schema)
    assert all(0 <= r["score"] <= 1 for r in toxicity.judged(clashing([(1, "a"), (2, "b")]), one).collect())


def test_very_long_words_and_texts(chars):
    texts = pa.array(["x1" * 5000, "a " * 20000 + "1d10t", "1 2 3 " * 3000], pa.large_string())
    rows, places = toxicity.features(texts, chars)
    assert len(rows) == len(places) and set(rows.tolist()) == {0, 1, 2}


def test_length_and_marks_hide_nothing(chars):
    def times(text, word):
        _, places = toxicity.features(pa.array([text], pa.large_string()), chars)
        return int((places == int(toxicity.word_hashes(pa.array([word], pa.large_string()))[0] % np.uint64(toxicity.PLACES))).sum())

    assert times("the idi" + "o" * 500 + "t on", "idiot") == 1  # stretched
    assert times("-".join(".".join("moron") for _ in range(30)), "moron") >= 29  # joined by marks
    for n in (9, 10, 40, 200):  # spaced out: no word is lost at a cut
        assert times(" ".join("m o r o n" for _ in range(n)), "moron") == n
    assert times("the i d i o t, on", "idiot") == times("the 'i d i o t' on", "idiot") == times("m o r o n, i d i o t!", "idiot") == 1


def least_cost(model, raw):
    """The least cost over all readings, by trying every one."""
    t = toxicity
    best = {}

    def walk(k, p, q, last, cost):
        if k == len(raw):
            best["cost"] = min(best.get("cost", float("inf")), cost + model.cost[p, q, 0])
            return
        char = raw[k]
        if char.isalpha():
            options = [(char, 0.0)]
        else:
            options = [(x, t.LOOK) for x in t.LOOKS.get(char, "")]
            if char in t.BETWEEN or char in t.EDGES:
                walk(k + 1, p, q, last, cost + t.DROP)
            if char in t.BETWEEN and q:
                walk(k + 1, q, 0, "", cost + t.BREAK + model.cost[p, q, 0])
            if char not in t.BETWEEN:
                options.append((char, t.STAY))
        for letter, extra in options:
            c = t._code(letter)
            walk(k + 1, q, c, letter, cost + extra + model.cost[p, q, c])
        if k and raw[k - 1] == char and last and (char == last or last in t.LOOKS.get(char, "")):
            walk(k + 1, p, q, last, cost + t.REPEAT)

    walk(0, 0, 0, "", 0.0)
    return best["cost"]


def test_search_is_exact():
    rng = random.Random(12)
    model = toxicity.CharModel(np.array([rng.randint(0, 9) ** 3 for _ in range(toxicity.LETTERS**3)]))
    for _ in range(300):
        raw = "".join(rng.choice("18!6|(.-+ab1@$") for _ in range(rng.randint(1, 9)))
        assert model.search(raw)[0] == pytest.approx(least_cost(model, raw), rel=1e-12), raw


def test_many_states_stay_bounded():
    rng = random.Random(13)
    model = toxicity.CharModel(np.ones(toxicity.LETTERS**3))
    long = "".join(rng.choice("1!|68@4(+#%&^=~*") for _ in range(3000))
    assert isinstance(model.restore(long), str)
