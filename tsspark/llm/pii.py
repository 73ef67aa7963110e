"""Personal data: listed patterns, and a skip-chain conditional random field that makes a document's labels agree.

The field's nodes are the words with a digit or ``@``; its labels are none, email, ip, card and phone. Neighbouring
nodes share a potential, and so do repeated or similar words however far apart (the same digits, or the same
characters without marks at the ends): two are tied to each other, more to a hub of their own, so all are two steps
apart. Sum-product messages run over this loopy graph until those of a document move by less than ``TOLERANCE``, all
documents of a batch at once. Only a document that never settles stops after ``ROUNDS``, with the messages it then has.
A word that then is more likely personal than not, and that no pattern span touches, is added with the words of the same
label next to it.

The field is trained piecewise on what the patterns find: a softmax over word features for the nodes, and for the two
kinds of edges the log odds of label pairs against chance. The training documents are a sample by hash of at most
``MAX_DOCUMENTS`` documents with a node; its features reach one task as counts. Documents without a digit or ``@`` have
no node and cost a scan only.

Spans are code points, end exclusive. Null and empty texts hold nothing. Repeated rows are judged row by row.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import in_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
MAX_DOCUMENTS = 5_000
PLACES = 1 << 12
TOLERANCE = 1e-6
ROUNDS = 1000
FOUND = "array<struct<kind:string,start:int,stop:int,base:boolean>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
_CUE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behind changes no match, as a match cannot end inside digits, and keeps long digit runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARKS = ".,;:!?\"'`()[]{}<>#*$%&|~^_=/\\"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the pattern finds, in order; kinds are numbered as in ``KINDS``."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if domain and start < at:
            out.append((start, 0, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        if _is_ip(m.group()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(word: str) -> str:
    out = []
    for c in word[:64]:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


class Nodes(NamedTuple):
    """The nodes of a batch: document, word number, span without marks, feature places, and silver label."""

    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    features: np.ndarray
    label: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    bars: np.ndarray | float = 0.0


def _bars(word: str, digits: str, shape: str) -> list[float]:
    """What speaks against the labels before any training: a word that cannot be one, and a little against all of them."""
    can = ("@" in word, shape == "9.9.9.9", 12 <= len(digits) <= 19, 3 <= len(digits) <= 15 or word.startswith("+"))
    return [0.0, *(-1.0 if c else -20.0 for c in can)]


def _place(name: str, value: object) -> int:
    return zlib.crc32(f"{name}={value}".encode()) % PLACES


def nodes_of(rows: list[int], texts: list[str], spans: list[list]) -> Nodes:
    row, starts, stops, features, labels, chain, skip, bars = [], [], [], [], [], [], [], []
    for r, text, own in zip(rows, texts, spans, strict=True):
        last_end, last_seen, before = -2, {}, ""
        k = 0
        for m in _CUE.finditer(text):
            raw = m.group()
            word = raw.strip(_MARKS) or raw
            a = m.start() + raw.find(word)
            a -= a > m.start() and text[a - 1] == "("  # an area code keeps its bracket
            b = m.start() + raw.find(word) + len(word)
            digits, node = _digits(word), len(row)
            while k < len(own) and own[k][2] <= a:
                k += 1
            label = next((kind + 1 for s, kind, e in own[k : k + 4] if s < b and a < e), 0)
            beside = m.start() - last_end == 1
            shape = _shape(word)
            features.append([
                _place("bias", 0), _place("shape", shape), _place("digits", min(len(digits), 20)), _place("shape+digits", (shape, min(len(digits), 20))),
                _place("luhn", 14 <= len(digits) <= 19 and luhn(digits)), _place("ip", shape == "9.9.9.9" and _is_ip(word)),
                _place("mail", "@" in word and "." in word.rpartition("@")[2]), _place("before", before if beside else ""),
            ])
            if beside:
                chain.append((node - 1, node))
            name = digits if len(digits) >= 6 else word.lower()
            if name in last_seen:
                skip.append((last_seen[name], node))
            last_seen[name], last_end, before = node, m.end(), shape
            row.append(r)
            starts.append(a)
            stops.append(b)
            labels.append(label)
            bars.append(_bars(word, digits, shape))
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Nodes(np.array(row, np.int64), np.array(starts, np.int64), np.array(stops, np.int64), np.array(features, np.int64).reshape(-1, 8), np.array(labels, np.int64), pairs(chain), pairs(skip), np.array(bars).reshape(-1, len(LABELS)))


class Field(NamedTuple):
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Label probabilities by loopy sum-product."""
        unary = self.weights[nodes.features].sum(1) + nodes.bars
        ties, hubs = _ties(nodes.skip, len(unary))
        edges, kind = np.concatenate((nodes.chain, ties)), np.repeat([0, 1], [len(nodes.chain), len(ties)])
        if not len(edges):
            return np.exp(unary - _logsum(unary, 1)[:, None])
        unary = np.concatenate((unary, np.zeros((hubs, len(LABELS)))))
        row = nodes.row[edges[:, 0]]
        pairs = np.array([[self.chain, self.skip], [self.chain.T, self.skip.T]])
        message = np.zeros((2, len(edges), len(LABELS)))  # along each edge, and back
        live = np.arange(len(edges))
        settled = unary.copy()
        for k in range(ROUNDS):
            source, old = edges[live].T, message[:, live]
            belief = settled.copy()
            np.add.at(belief, source[::-1], old)
            out = belief[source] - old[::-1]
            fresh = np.stack([_logsum(out + pairs[..., j][:, kind[live]], 2) for j in range(len(LABELS))], 2)
            move = fresh - _logsum(fresh, 2)[..., None] - old
            message[:, live] += move * 0.5 ** (1 + k // 250)
            going = np.unique(row[live][(np.abs(move) >= TOLERANCE).any((0, 2))])
            if not len(going):
                break
            left = np.isin(row[live], going)
            if 2 * left.sum() < len(left):  # documents share no edge, so the others are done
                done = live[~left]
                np.add.at(settled, edges[done].T[::-1], message[:, done])
                live = live[left]
        np.add.at(settled, edges[live].T[::-1], message[:, live])
        settled = settled[: len(nodes.row)]
        return np.exp(settled - _logsum(settled, 1)[:, None])


def _ties(skip: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Edges among equal words from each one's to its next, and the number of hubs, which are numbered from ``n`` on."""
    first: dict[int, int] = {}
    groups: dict[int, list[int]] = {}
    for a, b in skip[np.argsort(skip[:, 1], kind="stable")].tolist():
        first[b] = head = first.get(a, a)
        groups.setdefault(head, [head]).append(b)
    out, hubs = [], 0
    for members in groups.values():
        if len(members) == 2:
            out.append(tuple(members))
        else:
            out += [(m, n + hubs) for m in members]
            hubs += 1
    return np.array(out, np.int64).reshape(-1, 2), hubs


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _softmax_fit(features: np.ndarray, label: np.ndarray, n: np.ndarray, rounds: int = 300, rate: float = 0.3, penalty: float = 1e-4) -> np.ndarray:
    weights, squares, total = np.zeros((PLACES, len(LABELS))), np.full((PLACES, len(LABELS)), 1e-8), n.sum()
    wanted = np.eye(len(LABELS))[label]
    for _ in range(rounds if len(label) else 0):
        z = weights[features].sum(1)
        p = np.exp(z - _logsum(z, 1)[:, None])
        error = (p - wanted) * (n / total)[:, None]
        grad = penalty * weights
        np.add.at(grad, features.reshape(-1), np.repeat(error, features.shape[1], 0))
        squares += grad * grad
        weights -= rate * grad / np.sqrt(squares)
    return weights


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of label pairs against chance; pairs that were never seen keep little weight."""
    both = counts + counts.T + 0.5
    share = both / both.sum()
    one = share.sum(1)
    return np.clip(np.log(share / np.outer(one, one)), -3, 3)


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", max_documents: int = MAX_DOCUMENTS) -> Field:
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    if n > max_documents:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(950_000 * max_documents / n))

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch).to_pylist()
        nodes = nodes_of(list(range(len(texts))), texts, [base_spans(t) for t in texts])
        seen = np.concatenate((nodes.features, nodes.label[:, None]), 1)
        groups = [("node", seen)] + [(name, nodes.label[e]) for name, e in (("chain", nodes.chain), ("skip", nodes.skip))]
        names, values, counts = [], [], []
        for name, what in groups:
            if len(what):
                unique, many = np.unique(what, axis=0, return_counts=True)
                names += [name] * len(unique)
                values += unique.tolist()
                counts += many.tolist()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.list_(pa.int32())), pa.array(counts, pa.int64())], ["part", "what", "n"])

    def fit(batches):
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        table = pa.Table.from_batches(full).to_pydict()
        part = {name: sorted((tuple(w), n) for p, w, n in zip(table["part"], table["what"], table["n"], strict=True) if p == name) for name in ("node", "chain", "skip")}
        seen = np.array([w for w, _ in part["node"]], np.int64).reshape(-1, 9)
        weights = _softmax_fit(seen[:, :8], seen[:, 8], np.array([n for _, n in part["node"]], float))
        out = [("node", p, k, weights[p, k]) for p, k in zip(*np.nonzero(weights), strict=True)]
        for name in ("chain", "skip"):
            counts = np.zeros((len(LABELS), len(LABELS)))
            for (a, b), n in part[name]:
                counts[a, b] += n
            odds = _odds(counts)
            out += [(name, a, b, odds[a, b]) for a in range(len(LABELS)) for b in range(len(LABELS))]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.float64())], ["part", "a", "b", "weight"])

    counted = in_batches(rows, extract, "part string, what array<int>, n long").groupBy("part", "what").agg(F.sum("n").alias("n"))
    field = Field(np.zeros((PLACES, len(LABELS))), np.zeros((len(LABELS),) * 2), np.zeros((len(LABELS),) * 2))
    if n:
        for r in counted.repartition(1).mapInArrow(fit, "part string, a int, b int, weight double").collect():
            {"node": field.weights, "chain": field.chain, "skip": field.skip}[r["part"]][r["a"], r["b"]] = r["weight"]
    return field


def _found(texts: pa.Array, field: Field) -> list[list[dict]]:
    out: list[list] = [[] for _ in range(len(texts))]
    likely = pc.indices_nonzero(pc.match_substring_regex(texts, "[0-9@]")).to_pylist()
    if not likely:
        return out
    own = [texts[r].as_py() for r in likely]
    spans = [base_spans(t) for t in own]
    nodes = nodes_of(likely, own, spans)
    share = field.marginals(nodes) if len(nodes.row) else np.empty((0, len(LABELS)))
    best = share.argmax(1) if len(share) else np.empty(0, np.int64)
    picked = np.flatnonzero((best > 0) & (nodes.label == 0) & (share.max(1, initial=0) > 0.5) & field.weights.any())
    beside = {int(b): int(a) for a, b in nodes.chain}
    added: dict[int, list] = {}
    for k in picked.tolist():
        r, kind = int(nodes.row[k]), int(best[k]) - 1
        rows = added.setdefault(r, [])
        if rows and rows[-1][1] == kind and beside.get(k) == rows[-1][3]:
            rows[-1][2:] = [int(nodes.stop[k]), k]
        else:
            rows.append([int(nodes.start[k]), kind, int(nodes.stop[k]), k])
    for r, base in zip(likely, spans, strict=True):
        extra = [(a, kind, b, False) for a, kind, b, _ in added.get(r, []) if not any(s < b and a < e for s, _, e in base)]
        out[r] = [{"kind": KINDS[k], "start": a, "stop": b, "base": base_one} for a, k, b, base_one in sorted([(*x, True) for x in base] + extra)]
    return out


def find(df: DataFrame, field: Field, text: str = "text", column: str = "personal") -> DataFrame:
    """The rows, all columns, and ``column``: spans by start, then kind; ``base`` tells those of the patterns. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(column, pa.array(_found(texts_of(batch, text), shared.value), _KIND))

    return in_batches(df, work, df.withColumn(column, F.array().cast(FOUND)).schema)


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, counts of the base kinds, the base spans' digest, and all spans as text."""
    found = find(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), train(documents, key, text))
    written = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    base = F.filter("personal", lambda x: x["base"])
    count = lambda name: F.size(F.filter("personal", lambda x: x["base"] & (x["kind"] == name))).cast("long")
    return found.select(
        F.col("key").alias(key),
        *[count(name).alias(f"n_{name}") for name in KINDS],
        F.sha2(F.array_join(F.transform(base, written), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("personal", written), ",").alias("spans"),
    )
