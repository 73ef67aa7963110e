import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tsspark.llm import trie
from tsspark.llm.catalog import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, branched=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, role or ""), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda x: x[0])] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if branched else 0
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []

    def totals(p):
        below = [totals(x) for x in children[p]]
        leaves = sum(x[0] for x in below) if below else 1
        saved = sum(x[1] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(built[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        totals(())
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture
def turns(spark):
    return lambda rows, parts=3: spark.createDataFrame(rows, SCHEMA).repartition(parts)


def chats(n=260, seed=4, vocabulary=3, longest=7):
    rng = random.Random(seed)
    ids = rng.sample(range(2000), n)
    return [(c, t, rng.choice(["user", "assistant"]) if t else "user", rng.choice(["a", "bb", "ç🙂", "long text"][:vocabulary])) for c in ids for t in range(rng.randint(0, longest))]


def test_same_as_brute_force(turns, tables, spark):
    rows = chats()
    got = QUERIES["op12_prefix_trie"](spark, tables(conversations=turns(rows)))
    assert got.columns == COLUMNS and {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert shown(got) == brute(rows)


@pytest.mark.parametrize("shards", [1, 2, 9, 40])
def test_any_number_of_shards(turns, shards, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 4)
    rows = chats(150, 7, 2)
    assert shown(trie.prefix_trie(trie.branched_paths(turns(rows)), shards)) == brute(rows)
    assert shown(trie.prefix_trie(trie.paths(turns(rows)), shards)) == brute(rows, branched=False)


def test_splitters_look_at_few_turns_and_fit_their_bound(turns, monkeypatch):
    monkeypatch.setattr(trie, "SPLIT_TURNS", 2)  # conversations equal in two turns share a shard
    rows = chats(150, 8, 2)
    assert shown(trie.prefix_trie(trie.paths(turns(rows)), 30)) == brute(rows, branched=False)
    sample = [f"{a:024d}{b:024d}{c:024d}" for a in range(3) for b in range(9) for c in range(40)]
    found = trie.pick_splitters(sample, 50)
    assert found == sorted(set(found)) and 30 < len(found) < 50 and all(len(s) % trie.WIDTH == 0 for s in found)
    assert sum(map(len, trie.pick_splitters(sample, 50, 600))) <= 600
    assert trie.pick_splitters([], 5) == trie.pick_splitters(["a" * 24] * 90, 5) == []


def test_hot_first_turn_and_hot_conversation(turns, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 5)
    rows = [(c, 0, "user", "hello") for c in range(0, 900, 2)]
    rows += [(c, 1, "assistant", "same answer") for c in range(0, 600, 2)]
    rows += [(c, 1, "assistant", f"answer {c}") for c in range(600, 900, 2)] + [(c, 0, "user", f"own {c}") for c in range(1, 200, 2)]
    df = turns(rows, 6)
    packed = trie.grouped(trie.paths(df))
    assert packed.agg(F.max("n")).first()[0] <= 32
    got = shown(trie.prefix_trie(trie.paths(df), 12))
    assert got == brute(rows, branched=False)
    assert max(r[4] for r in got) == 151


def test_nulls_ties_repeats_negative_ids_and_clashing_names(turns):
    rows = [(5, None, "user", "first"), (5, 0, None, "x"), (5, 0, "user", None), (5, 1, "user", "z"), (5, 1, "user", "z"), (None, 0, "user", "lost")]
    rows += [(-7, 0, "user", "first"), (-100, 0, "u", "neg"), (100, None, None, None), (101, None, None, None), (102, 9, "role:", "1"), (103, 9, "role", ":1")]
    df = turns(rows).withColumns({n: F.lit("x") for n in ("token", "path", "base", "head", "tokens", "n", "ids", "chunk", "shard", "bone", "above")})
    assert shown(trie.prefix_trie(trie.branched_paths(df), 4)) == brute(rows)


def test_empty_table_and_turnless_conversations(turns):
    assert trie.prefix_trie(trie.branched_paths(turns([]))).collect() == []
    short = next(c for c in range(150, 199) if zlib.crc32(str(c).encode()) % 6 == 3)  # conversation 100 is absent
    rows = [(short, 0, "user", "dropped"), (short, 1, "user", "dropped")]
    assert shown(trie.prefix_trie(trie.branched_paths(turns(rows)))) == brute(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_long_conversation_and_long_text(turns):
    rows = [(1, t, "user", f"turn {t % 7}") for t in range(3000)] + [(2, t, "user", f"turn {t % 7}") for t in range(2990)] + [(2, 2991, "user", "é" * 200_000)]
    got = shown(trie.prefix_trie(trie.paths(turns(rows)), 3))
    assert len(got) == 3002 and max(r[6] for r in got) == 2990 * 6
    assert sorted(r[1] for r in got)[-1] == 3000


def test_texts_of_nodes(turns):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, "there")]
    nodes = trie.with_texts(trie.prefix_trie(trie.paths(turns(rows))), turns(rows))
    assert sorted((r["depth"], r["role"], r["text"], r["n_convs"]) for r in nodes.collect() if r["depth"]) == [(1, "user", "hi", 2), (2, "", "there", 1)]
