import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tsspark.llm import langid
from tsspark.llm.catalog import QUERIES

SYLLABLES = {"aa": ["ba", "do", "mi", "ke"], "bb": ["stra", "ing", "th", "ow"], "cc": ["éa", "ou", "çi", "ien"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", ",", ". 7"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(k, prose(lang := rng.choice(list(SYLLABLES)), rng.choice([2, 5, 30, 200]), rng), lang) for k in range(400)]


@pytest.fixture
def docs(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    return build


def rest(i):
    return zlib.crc32(str(i).encode()) % 4


def test_held_out_accuracy(docs, rows, tables, spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_language"](spark, tables(documents=docs(rows))).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows if rest(i) == 2]
    assert held and all(got[i]["held_out"] == (rest(i) == 2) for i, *_ in rows)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    kept = [(i, lang) for i, lang in held if not got[i]["rejected"]]
    assert len(kept) > 0.9 * len(held) and np.mean([got[i]["lang_pred"] == lang for i, lang in kept]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_and_sources_of_held_out_rows_change_nothing(docs, rows):
    wrong = [(i, t, "zz" if rest(i) == 2 else lang) for i, t, lang in rows]
    a, b = langid.fit(docs(rows)), langid.fit(docs(wrong).withColumn("source", F.lit("other")))
    assert a.langs == b.langs == sorted(SYLLABLES) and (a.table == b.table).all() and a[3:] == b[3:]


def test_scores_are_those_of_the_model_by_hand(docs, rows):
    model = langid.fit(docs(rows))
    got = {r["doc_id"]: r for r in langid.judged(docs(rows), model).collect()}
    import re

    for i, t, _ in rows[:40]:
        grams = [w[k : k + n] for w in (f"<{x}>" for x in re.findall(r"[^\W\d_]+", t.lower())) for n in (2, 3, 4) for k in range(len(w) - n + 1)]
        ids = [int(langid.chained(langid.mixed(np.array([ord(c) for c in g], np.uint64) + np.uint64(1)), len(g))[0] % np.uint64(langid.BUCKETS)) for g in grams]
        logits = np.mean([model.table[k] for k in ids], 0) / langid.UNIT + model.bias
        z = logits * np.exp(model.sharp + model.slope * np.log(len(ids)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == model.langs[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), rel=1e-9)


def test_letterless_and_null_texts_are_und(docs, rows):
    model = langid.fit(docs(rows))
    texts = [None, "", " \n ", "12 34 !? ___", "🙂", "Привет мир", "badomi"]
    got = {r["doc_id"]: r for r in langid.judged(docs([(k, t, None) for k, t in enumerate(texts)]), model).collect()}
    assert [got[k]["lang_pred"] == "und" for k in range(7)] == [True] * 5 + [False] * 2
    assert all(got[k]["score"] == 0 and got[k]["rejected"] for k in range(5))
    assert got[5]["rejected"] and not got[6]["rejected"] and got[6]["lang_pred"] == "aa"


def test_rows_do_not_depend_on_their_neighbours(docs, rows, monkeypatch):
    model = langid.fit(docs(rows))
    texts = [t for _, t, _ in rows[:30]] + ["dobami " * 90_000, "mi" * 300_000]
    together = langid.predict(pa.array(texts, pa.large_string()), model)
    alone = [langid.predict(pa.array([t], pa.large_string()), model) for t in texts]
    monkeypatch.setattr(langid, "STRETCH", 50)
    small = langid.predict(pa.array(texts[:30], pa.large_string()), model)
    assert (together[0] == [a[0][0] for a in alone]).all() and (together[1] == [a[1][0] for a in alone]).all()
    assert (small[1] == together[1][:30]).all()


def test_calibration_follows_accuracy():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 4000)
    signal = np.where(rng.random(4000) < 0.9, labels, 1 - labels)  # one in ten is wrong, whatever the size of the logits
    logits = np.zeros((4000, 2))
    logits[np.arange(4000), signal] = 3
    sharp, slope, threshold = langid.calibrated(logits, np.full(4000, 20), labels)
    p = langid._softmax(logits * np.exp(sharp + slope * np.log(20)))
    assert p.max() == pytest.approx(0.9, abs=0.05) and threshold == 1.0
    assert langid.calibrated(np.zeros((0, 2)), np.zeros(0), np.zeros(0, int)) == (0.0, 0.0, 0.5)


def test_nothing_to_learn_from_null_ids_repeats_and_clashing_names(docs, rows, clashing):
    nothing = langid.judged(docs(rows[:5]), langid.fit(docs([(i, t, None) for i, t, _ in rows]))).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in nothing} == {("und", 0.0, True)}
    assert langid.judged(docs([]), langid.fit(docs([]))).count() == 0
    odd = [(None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1]), (None, None)]
    got = langid.judged(clashing(odd), langid.fit(docs(rows + [(None, rows[0][1], rows[0][2])]))).collect()
    assert len(got) == 4 and sorted(r["doc_id"] or 0 for r in got) == [0, 0, 3, 3] and not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_sample_is_bounded_and_spread_over_languages(docs):
    rng = random.Random(6)
    rows = [(k, prose("aa", 3, rng), "aa") for k in range(3000)] + [(3000 + k, prose("bb", 3, rng), "bb") for k in range(40)]
    rows += [(7777, "same text", "aa")] * 500
    whole = langid.examples(docs(rows), most=200).where("size > 1 or calibrates").select("pick", "lang").distinct().groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in whole}
    assert 50 < counts["aa"] < 160 and counts["bb"] > 20
