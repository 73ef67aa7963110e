import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tsspark.llm import resample
from tsspark.llm.catalog import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(rows, target, longest=1, percent=10, least=20):
    """(n_features, weight, score, rank) of every row, in the order given."""
    own = [features(t, longest) for _, t in rows]
    s = Counter(b for _, f in own for b in f)
    t = Counter(b for x in target for b in features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (s_all + 10000)) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    out = []
    for (i, _), (words, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    rivals = sorted((k for k in range(len(rows)) if out[k][4] >= least), key=lambda k: (-out[k][2], rows[k][0] is None, rows[k][0] or 0))
    for place, k in enumerate(rivals[: percent * len(rivals) // 100]):
        out[k][3] = place + 1
    return [tuple(x[:4]) for x in out]


def shown(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def expected(rows, *args, **kw):
    return sorted(((i, *x) for (i, _), x in zip(rows, brute(rows, *args, **kw), strict=True)), key=str)


@pytest.fixture
def benchmark(spark):
    return lambda texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def many(corpus):
    rng = random.Random(3)
    return corpus + [(200 + k, " ".join(rng.choice(corpus[:60])[1].split()[:60] + [rng.choice(["Zeta9", "ünï", "x-y"])])) for k in range(140)]


def test_same_as_brute_force(documents, benchmark, tables, spark, corpus):
    rows, target = many(corpus), [corpus[0][1], corpus[5][1], None, ""]
    got = QUERIES["op13_resample"](spark, tables(documents=documents(rows, 5), benchmark=benchmark(target)))
    assert [n for n, _ in got.dtypes] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert shown(got) == expected(rows, target)


def test_runs_of_words_do_not_cross_texts(documents, benchmark, corpus):
    rows, target = many(corpus), [corpus[0][1]]
    got = resample.judged(documents(rows, 3), benchmark(target), resample.Draw(longest=3, percent=25))
    assert shown(got) == expected(rows, target, longest=3, percent=25)


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1000) for _ in range(5000)] + [0] * 2000
    scores = spark.createDataFrame([(k, int(v), k) for k, v in enumerate(values)], "key long, score long, row long").repartition(7)
    order = sorted(((int(v), k) for k, v in enumerate(values)), key=lambda x: (-x[0], x[1]))
    for percent in (1, 10, 42, 57, 99, 100):
        size = 70 * percent
        last = resample.cutoff(scores, percent)
        assert (last.size, last.score, last.key) == (size, *order[size - 1])
        if percent in (1, 10, 99):
            assert last.sorted_rows < 500
    poor = resample.cutoff(scores, 10, half_width=1e-9, sketch_k=8)  # a sketch that misses, a bracket of one value
    assert poor.tries > 1 and (poor.score, poor.key) == order[699]
    assert resample.cutoff(scores.where("false"), 10) is None and resample.cutoff(scores.limit(9), 10) is None


def test_ranks_over_many_parts_with_ties(spark):
    rows = [(k % 50, k // 100, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, score long, row long").repartition(11)
    got = {(r["key"], r["score"], r["row"]): r["rank"] for r in resample.ranked(df).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0], r[2]))
    assert got == {r: k + 1 for k, r in enumerate(order)}


def test_repeated_rows_null_ids_and_clashing_names(clashing, benchmark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text)] * 25 + [(None, text)] * 5 + [(2, None), (3, ""), (None, None)]
    docs = clashing(rows).withColumns({n: F.lit("x") for n in ("row", "rank", "weight", "part", "place", "name", "n_words")})
    got = shown(resample.judged(docs, benchmark([text])))
    assert got == expected(rows, [text])
    assert sum(r[4] is not None for r in got) == 3
    out = resample.resample(docs, benchmark([text]))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == ({1} if brute(rows, [text])[0][2] > brute(rows, [text])[25][2] else {None})


def test_empty_tables(documents, benchmark, corpus):
    assert resample.judged(documents([]), benchmark(["a b"])).count() == 0
    rows = corpus[:60]
    assert shown(resample.judged(documents(rows), benchmark([]))) == expected(rows, [])
    assert all(r["rank"] is None for r in resample.judged(documents([(1, "a b c")]), benchmark(["a"])).collect())


def test_very_long_text_counts_as_a_whole(documents, benchmark):
    rows = [(k, "common words " * 20) for k in range(12)] + [(99, "target " * 900_000)]
    got = {r["doc_id"]: r for r in resample.judged(documents(rows), benchmark(["target " * 50])).collect()}
    assert got[99]["n_features"] == 900_000
    assert {i: (r["n_features"], r["weight"], r["score"], r["rank"]) for i, r in got.items()} == {i: x for (i, _), x in zip(rows, brute(rows, ["target " * 50]), strict=True)}
