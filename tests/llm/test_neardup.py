import re
from itertools import combinations

import pytest

from tsspark.llm import neardup
from tsspark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def judged(df, width):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, neardup.Banding(width=width)).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_same_as_all_pairs(documents, corpus, width):
    assert judged(documents(corpus), width) == brute(corpus, width)


def test_chain_of_copies_is_one_component(documents):
    """Neighbours are alike, the ends are not; the ends still share a component."""
    words = [f"w{k}" for k in range(140)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 80])) for k in range(12)]
    want = brute(rows, 2)
    assert len({c for _, c, _ in want.values()}) == 1
    assert judged(documents(rows), 2) == want


@pytest.mark.parametrize("crowd", [3, 64, 10_000])
def test_large_group_of_near_copies(documents, monkeypatch, crowd):
    """The same by blocks and by prefixes, also in many small blocks."""
    import random

    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "CROWD_SHINGLES", 3_000)

    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(150):
        own = [w if rng.random() > 0.06 * (k % 4) / 2 else f"n{k}-{j}" for j, w in enumerate(base)]
        rows.append((k, " ".join(own)))
    assert judged(documents(rows), 2) == brute(rows, 2)


def test_table(documents, tables, spark, corpus):
    from tsspark.llm.catalog import QUERIES

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op2_near_duplicates"](spark, tables(documents=documents(corpus))).collect()}
    assert got == brute(corpus, 2)


def test_empty_table_nulls_and_clashing_names(documents, clashing, corpus):
    assert judged(documents([]), 2) == {}
    rows = [*corpus[:5], (None, corpus[2][1]), (None, None)]
    got = neardup.near_duplicates(clashing(rows), neardup.Banding(width=2)).collect()
    assert len(got) == 7
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(None, 2, False), (None, None, False)}


def test_stage_keeps_one_row_per_component(clashing):
    text = "one two three four five six seven"
    rows = clashing([(3, text), (1, text), (1, text), (2, "other words stand here for the test"), (None, text), (5, None), (6, None)])
    kept = neardup.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]


def test_slices_of_a_batch_give_the_same_sets(documents, corpus, monkeypatch):
    want = judged(documents(corpus), 2)
    monkeypatch.setattr("tsspark.llm.common.BATCH_CHARS", 200)
    assert judged(documents(corpus, 1), 2) == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {*range(41), 100, 101, 102}
    assert len({got[k] for k in range(41)}) == 1 and len({got[k] for k in (100, 101, 102)}) == 1 and got[0] != got[100]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
