import hashlib
import random
import re

import numpy as np
import pytest

from tsspark.llm import pii
from tsspark.llm.catalog import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def count(text):
    return sum("0" <= c <= "9" for c in text)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= count(m.group()) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= count(m.group()) <= 15]
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    "mail bob.k@host.example.com, or x@y then a@b@c.d", "from 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "call +1 (386) 555-3733 or +49 30 123456", "é🙂 x+tag@sub.domain.org 192.168.000.001", "@.@ 1 2 3 +", "", None, "no data", "7" * 4000 + "@" + "b" * 3000,
]


def test_base_spans_same_as_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("a1@.-+ (2") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = list(enumerate(TEXTS))

    def luhn_card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    makers = [
        luhn_card, lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: "".join(rng.choice("abcdef") for _ in range(6)) + f".{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com",
    ]
    for k in range(400):
        words = [rng.choice(["the", "on", "thing", "eating", "of"]) for _ in range(30)]
        for _ in range(rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), makers[rng.randrange(4)]())
        out.append((100 + k, " ".join(words)))
    return out


def test_query(documents, tables, spark, rows):
    got = {r["doc_id"]: r for r in QUERIES["op6_personal_data"](spark, tables(documents=documents(rows))).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base, r = brute(text), got[i]
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(x[1] == j for x in base) for j in range(4)), i
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(filter(None, written(base).split(","))) <= set(r["spans"].split(","))
    assert got[8]["spans"] == ""


def test_field_adds_what_patterns_lose(documents, rows):
    """A card number next to another number is one failed match to the pattern."""
    field = pii.train(documents(rows))
    card = next(m.group() for _, t in rows for m in re.finditer(r"\b4[0-9]{15}\b", t or "") if pii.luhn(m.group()))
    text = f"pay {card} 12345 now {card} then"
    found = pii.find(documents([(1, text)]), field).first()["personal"]
    spans = {(text[f["start"] : f["stop"]], f["kind"], f["base"]) for f in found}
    assert (card, "card", True) in spans and (card, "card", False) in spans
    assert not pii.find(documents([(1, "room 12 has 3 chairs in 1999")]), field).first()["personal"]


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.PLACES, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    nodes = pii.Nodes(np.zeros(4, int), np.arange(4), np.arange(4) + 1, rng.integers(0, pii.PLACES, (4, 8)), np.zeros(4, int), np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    unary = field.weights[nodes.features].sum(1)
    joint = np.exp(unary[0][:, None, None, None] + unary[1][None, :, None, None] + unary[2][None, None, :, None] + unary[3][None, None, None, :]
                   + field.chain[:, :, None, None] + field.chain[None, :, :, None] + field.skip[None, :, None, :])
    joint /= joint.sum()
    want = np.stack([joint.sum((1, 2, 3)), joint.sum((0, 2, 3)), joint.sum((0, 1, 3)), joint.sum((0, 1, 2))])
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert np.allclose(field.marginals(nodes), want, atol=1e-6)
    finally:
        pii.ROUNDS = rounds


def test_skip_edges_tie_repeated_words():
    nodes = pii.nodes_of([0], ["5550001234 and far away (5550001234), a1 b a1"], [[]])
    assert nodes.skip.tolist() == [[0, 1], [2, 3]]


def test_evidence_reaches_all_repeats():
    k = len(pii.LABELS)
    skip = np.where(np.eye(k) > 0, 2.0, -2.0)
    field = pii.Field(np.zeros((pii.PLACES, k)), np.zeros((k, k)), skip)
    nodes = pii.nodes_of([0, 1], ["a lone 7", " and then ".join(["4111222233334444"] * 50)], [[], []])
    bars = np.zeros((51, k))
    bars[1, 3] = 5.0  # clear context at the first place alone
    got = field.marginals(nodes._replace(bars=bars))
    hub = np.exp(skip) @ np.exp(bars[1])
    others = np.exp(skip).sum(1)
    want = hub * others**48 @ np.exp(skip)
    assert np.allclose(got[2:], want / want.sum(), atol=1e-6) and (got[1:].argmax(1) == 3).all()
    assert np.allclose(got[0], 1 / k)


def test_messages_settle_on_long_chains_and_loops():
    rng = np.random.default_rng(5)
    k, n = len(pii.LABELS), 300
    field = pii.Field(rng.normal(size=(pii.PLACES, k)) / 3, rng.normal(size=(k, k)) + 2 * np.eye(k), 2 * np.eye(k))
    chain = np.stack((np.arange(n - 1), np.arange(1, n)), 1)
    nodes = pii.Nodes(np.zeros(n, int), np.arange(n), np.arange(n) + 1, rng.integers(0, pii.PLACES, (n, 8)), np.zeros(n, int), chain, np.empty((0, 2), int))
    unary, step = np.exp(field.weights[nodes.features].sum(1)), np.exp(field.chain)
    ahead, back = np.ones((n, k)), np.ones((n, k))
    for i in range(1, n):
        ahead[i] = (ahead[i - 1] * unary[i - 1]) @ step
        ahead[i] /= ahead[i].sum()
        back[n - 1 - i] = step @ (back[n - i] * unary[n - i])
        back[n - 1 - i] /= back[n - 1 - i].sum()
    want = ahead * unary * back
    assert np.allclose(field.marginals(nodes), want / want.sum(1)[:, None], atol=1e-5)
    loops = nodes._replace(skip=np.array([[i, i + 30] for i in range(n - 30)]))
    got = field.marginals(loops)
    rounds, pii.ROUNDS = pii.ROUNDS, 10 * pii.ROUNDS
    try:
        assert np.allclose(field.marginals(loops), got, atol=1e-5)
    finally:
        pii.ROUNDS = rounds


def test_empty_table_null_ids_and_clashing_names(documents, clashing):
    assert pii.judged(documents([])).count() == 0
    got = pii.judged(clashing([(None, "a@b.c"), (1, None), (1, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in got) == [(0, 1), (1, 0), (1, 0)]
