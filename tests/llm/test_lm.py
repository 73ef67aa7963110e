import math
import re
import zlib
from collections import Counter

import pytest

from tsspark.llm import lm
from tsspark.llm.catalog import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\0"]


def rest(i):
    return zlib.crc32(str(i).encode()) % 10


def brute_base(rows):
    seen = Counter(w for i, t in rows if rest(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    out = {}
    for i, t in rows:
        own = tokens(t)
        out[i] = (rest(i) == 0, len(own), sum(seen[w] > 0 for w in own), n, sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    return out


def brute_model(rows):
    """The interpolated bigram model, its weights fitted token by token."""
    def counts(take):
        one, two, docs = Counter(), Counter(), 0
        for i, t in rows:
            if take(rest(i)):
                own = tokens(t)
                docs += 1
                one.update(own)
                two.update(zip([None, *own], own, strict=False))
        return one, two, docs

    def shares(model, before, word):
        one, two, docs = model
        context = docs if before is None else one[before]
        return math.ceil(math.log2(context + 1)), (1 / (len(one) + 1), one[word] / max(sum(one.values()), 1), two[before, word] / max(context, 1))

    kept, full = counts(lambda r: r > 1), counts(lambda r: r > 0)
    events = {}
    for i, t in rows:
        if rest(i) == 1:
            own = tokens(t)
            for pair in zip([None, *own], own, strict=False):
                bucket, s = shares(kept, *pair)
                rounded = (s[0], *(math.exp(round(math.log(x) * lm.STEPS) / lm.STEPS) if x else 0 for x in s[1:]))
                events.setdefault(bucket, []).append(rounded)
    weights = {}
    for bucket, own in events.items():
        mix = [1 / 3] * 3
        for _ in range(50):
            parts = [[m * x for m, x in zip(mix, s, strict=True)] for s in own]
            mix = [sum(p[k] / sum(p) for p in parts) / len(own) for k in range(3)]
        mix = [max(m, 1e-5) for m in mix]
        weights[bucket] = [m / sum(mix) for m in mix]
    out = {}
    for i, t in rows:
        own, total = tokens(t), 0.0
        for pair in zip([None, *own], own, strict=False):
            bucket, s = shares(full, *pair)
            total += math.log10(sum(m * x for m, x in zip(weights.get(bucket, [1 / 3] * 3), s, strict=True)))
        out[i] = total
    return out


def check(got, rows):
    base, model = brute_base(rows), brute_model(rows)
    assert set(got) == set(base)
    for i, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == base[i][:4]
        assert r["base_score"] == pytest.approx(base[i][4], rel=1e-9)
        assert r["score"] == pytest.approx(model[i], rel=1e-6)


def test_same_as_brute_force(documents, tables, spark, corpus):
    rows = corpus + [(400 + k, t) for k, (_, t) in enumerate(corpus[:40])]
    got = {r["doc_id"]: r for r in QUERIES["op3_lm_score"](spark, tables(documents=documents(rows))).collect()}
    check(got, rows)


def test_many_blocks_and_buckets(documents, corpus):
    check({r["doc_id"]: r for r in lm.scored(documents(corpus, 3), block_chars=700, bucket_entries=60).collect()}, corpus)


def test_model_beats_the_base_on_held_out_text(documents):
    import random

    rng = random.Random(1)
    follow = {w: [f"v{(7 * w + k) % 50}" for k in range(2)] for w in range(50)}
    rows = []
    for i in range(300):
        w, own = 0, []
        for _ in range(60):
            own.append(rng.choice(follow[w]))
            w = int(own[-1][1:])
        rows.append((i, " ".join(own)))
    got = [r for r in lm.scored(documents(rows)).collect() if r["held_out"]]
    assert got and all(r["score"] > 0.8 * r["base_score"] for r in got)


def test_weights_sum_to_one_and_follow_the_evidence():
    cells = [(3, [-8, -1], 1e-3, 90), (3, [-8, 1], 1e-3, 10), (0, [-8, 1], 1e-3, 5)]
    weights = lm.fit_weights(cells, 2)
    assert all(sum(w) == pytest.approx(1) for w in weights.values())
    assert weights[3][2] > 0.8 and weights[0][2] < 0.01


def test_empty_table_null_ids_and_clashing_names(documents, clashing):
    assert lm.scored(documents([])).count() == 0
    rows = lm.scored(clashing([(None, "a b"), (None, None), (7, "a")])).collect()
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"]) for r in rows) == [(0, False, 1), (0, False, 3), (7, False, 2)]
    only = lm.scored(documents([(i, "a b c") for i in range(200) if rest(i) == 0])).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in only)


def test_second_exchange_gives_the_same(documents, corpus, monkeypatch):
    monkeypatch.setattr(lm, "STRETCH_BLOCKS", 3)
    for coarse in (0, 2):
        got = lm.scored(documents(corpus, 3), block_chars=700, bucket_entries=60, coarse_bits=coarse)
        check({r["doc_id"]: r for r in got.collect()}, corpus)


def test_totals_beyond_32_bits():
    import numpy as np

    def row(block, kind, grams, counts):
        return {"block": block, "kind": kind, "bucket": 0, "tokens": 1, "documents": 1, "grams": lm._pack(np.array(grams, np.uint64)), "counts": lm._pack(np.array(counts, np.uint32))}

    most = 2**32 - 1
    rows = [row(1, lm.KEPT, [5, 9], [most, 1]), row(2, lm.KEPT, [5], [most]), row(3, lm.DELETED, [5, 9], [most, most]), row(4, lm.HELD_OUT, [7, 9], [0, 0])]
    got = {r["block"]: r for r in lm._answer_blocks(rows)}
    assert lm._unpack(got[1]["totals"], np.uint64).tolist() == [3 * most, most + 1] == lm._unpack(got[3]["totals"], np.uint64).tolist()
    assert lm._unpack(got[3]["kept"], np.uint64).tolist() == [2 * most, 1] and lm._unpack(got[4]["totals"], np.uint64).tolist() == [0, most + 1]
    wide = [{**r, "bucket": 0} for r in rows]
    repacked = [{**p, "stretch": 0} for p in lm._repacker(2, 0)([{**r, "stretch": 0} for r in wide])]
    by_fine = {}
    for p in repacked:
        by_fine.setdefault(p["fine"], []).append(p)
    answered = [a for f in sorted(by_fine) for a in lm._answer_stretches(by_fine[f])]
    again = {r["block"]: r for r in lm._unpack_stretch(answered)}
    assert {b: (r["totals"], r["kept"], r["tokens"]) for b, r in again.items()} == {b: (r["totals"], r["kept"], r["tokens"]) for b, r in got.items()}


def test_error_of_the_rounded_fit(documents, corpus, monkeypatch):
    """Weights fitted to exact estimates give nearly the same scores: the rounding costs less than 2 % of any score."""
    rows = corpus + [(400 + k, t) for k, (_, t) in enumerate(corpus[:40])]
    got = {r["doc_id"]: r["score"] for r in lm.scored(documents(rows)).collect()}
    monkeypatch.setattr(lm, "STEPS", 1e9)  # brute_model rounds to so fine steps
    exact = brute_model(rows)
    assert max(abs(got[i] / exact[i] - 1) for i in got) < 0.02
    assert abs(sum(got.values()) / sum(exact.values()) - 1) < 0.005
