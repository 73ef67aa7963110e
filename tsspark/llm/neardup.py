"""Near-duplicate documents: MinHash with tensored banding, links confirmed on the full shingle sets.

Documents with equal shingle sets form a class; only classes are compared. Two small collections of ``m``
sub-keys, each made of ``rows`` min-hashes, are computed per class. The key of table (i, j) combines sub-key i of
the first collection with sub-key j of the second: ``m * m`` tables of ``2 * rows`` rows from ``2 * m * rows``
min-hashes, where separate bands would need ``2 * rows * m * m``. A pair of similarity s shares a table unless one
collection has no common sub-key, so it is missed with probability at most 2 * (1 - s ** rows) ** m: 2.1e-5 at
s = 0.8 with m = 16 and rows = 3, 5e-7 at 0.85, less above.

Sub-keys that one class holds alone cannot lead to a partner and go first. Inside a table's bucket no pairs are
emitted. Every class is compared with the bucket's leader (one of four orders, by table). What this leaves outside its
bucket's main component is joined exactly: sets as similar as wanted share one of their rarest shingles (prefix filter),
so only classes that do are compared; what is left outside a large component is compared with all of its bucket mates
in blocks. Every two classes that share a table are thus connected or known to be unlike, while a group of copies costs
a few comparisons per member, however large it is.

A document's set holds its distinct runs of ``width`` lower-cased words (A-Z only); with fewer words the whole
sequence is one shingle; null and empty texts have no set and no links. Sets are compared by 64-bit hashes of the
shingles, classes are named by a 128-bit digest of the set. Documents without ``doc_id`` take part as copies of
others but name no component. Repeated rows are judged row by row and get equal results.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import chained, findable, in_batches, list_column, mixed, stored, texts_of, word_hashes, word_lists
from tsspark.llm.components import components


class Banding(NamedTuple):
    width: int = 5
    m: int = 16
    rows: int = 3
    percent: int = 80
    seed: int = 7


#: Orders in which a bucket's leader comes first.
ORDERS = 4
#: Members from which a component is compared in blocks, and shingles in a block. Both ways give the same links.
CROWD, CROWD_SHINGLES = 64, 1_000_000


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, starts = word_lists(texts)
    hashes, out = word_hashes(words), []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = hashes[a:b]
        out.append(np.unique(chained(own, min(width, len(own)))) if len(own) else own)
    return out


def _sub_keys(sets: list[np.ndarray], banding: Banding) -> np.ndarray:
    """``2 * m`` sub-keys for each of the (non-empty) sets; equal only within one place."""
    rng = np.random.default_rng(banding.seed)
    count = 2 * banding.m * banding.rows
    flips, factors = rng.integers(0, 2**32, count, dtype=np.uint32), rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    # half of each hash orders the shingles; equal minima of unlike sets only add a candidate
    flat, at = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    keys = np.empty((len(sets), 2 * banding.m), np.uint64)
    for place in range(2 * banding.m):
        key = np.full(len(sets), place + 1, np.uint64)
        for k in range(place * banding.rows, (place + 1) * banding.rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((flat ^ flips[k]) * factors[k], at).astype(np.uint64))
        keys[:, place] = key
    return keys


def signatures(df: DataFrame, banding: Banding, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, n, keys) per row; ``node`` digests the set and is null for empty ones."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch), banding.width)
        full = [k for k, s in enumerate(sets) if len(s)]
        keys = np.zeros((len(sets), 2 * banding.m), np.uint64)
        if full:
            keys[full] = _sub_keys([sets[k] for k in full], banding)
        node = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
        starts = np.arange(len(sets) + 1) * 2 * banding.m
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), node, pa.array([len(s) for s in sets], pa.int64()), list_column(keys.reshape(-1).view(np.int64), starts, pa.int64())], ["doc_id", "node", "n", "keys"])

    return in_batches(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), work, f"doc_id {dict(df.dtypes)[key]}, node binary, n long, keys array<bigint>")


def table_keys(classes: DataFrame, banding: Banding) -> DataFrame:
    """(key, side, node, n): the buckets of all tables that hold two classes or more; ``side`` is the leader's order."""
    m = banding.m
    single = classes.select("node", "n", F.posexplode("keys").alias("place", "sub"))
    shared = single.groupBy("sub").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sub")
    held = single.join(shared, "sub").groupBy("node", "n").agg(F.collect_list(F.struct("place", "sub")).alias("subs"))
    first = held.select("node", "n", "subs", F.explode(F.filter("subs", lambda x: x["place"] < m)).alias("a"))
    pairs = first.select("node", "n", "a", F.explode(F.filter("subs", lambda x: x["place"] >= m)).alias("b"))
    return pairs.select(F.xxhash64("a.sub", "b.sub").alias("key"), ((F.col("a.place") + F.col("b.place")) % ORDERS).alias("side"), "node", "n")


def _size_fits(percent: int):
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(key, node, n, leader, m): every member of a bucket with two classes or more, and the bucket's leader."""
    rank = F.struct(F.xxhash64("node", "side").alias("r"), F.col("node").alias("leader"), F.col("n").alias("m"))
    leaders = buckets.groupBy("key").agg(F.min(rank).alias("first"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    return buckets.join(leaders, "key").select("key", "node", "n", F.col("first.leader").alias("leader"), F.col("first.m").alias("m"))


def open_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, n, component, main): buckets with several components, and the one with most members in each.

    A bucket of two is left out: its only pair has been compared.
    """
    named = members.join(label, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("key", "component").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("held")).where("parts > 1 and held > 2").select("key", "main")
    return stored(named.join(main, "key"), "open-buckets")


def crowded(mixed_up: DataFrame, label: DataFrame) -> DataFrame:
    """(main, node, n, component, outside): large components, and what shares an open bucket that they are the main one of."""
    large = label.groupBy("component").count().where(F.col("count") >= CROWD).select(F.col("component").alias("main"))
    held = mixed_up.groupBy("main", "node").agg(F.first("n").alias("n"), F.first("component").alias("component"))  # one row for all buckets
    return held.join(large, "main").withColumn("outside", F.col("component") != F.col("main"))


def crowd_links(near: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """Links (a, b) between the classes outside a large component and all that share open buckets with it.

    The classes outside, a small part, are dealt into blocks, all classes likewise, both of bounded size; a task
    holds a block of either and counts common shingles by posting lists. Only links leave it.
    """
    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [x.tobytes() for x in shingle_sets(texts_of(batch), banding.width)]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], ["node", "shingles"])

    blocks = lambda total: F.ceil(total / CROWD_SHINGLES).cast("int")
    totals = near.groupBy("main").agg(blocks(F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0))).alias("few"), blocks(F.sum("n")).alias("many")).where("few > 0")
    packed = in_batches(texts.join(near.select("node").distinct(), "node", "left_semi").select("node", "text"), sets, "node binary, shingles binary")
    rows = near.join(totals, "main").join(packed, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("outside").select("main", own("few").alias("i"), every("many").alias("j"), F.lit(True).alias("asks"), "node", "shingles")
    right = rows.select("main", every("few").alias("i"), own("many").alias("j"), F.lit(False).alias("asks"), "node", "shingles")

    def links(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        nodes = table["node"].to_pylist()
        found = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        held, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: list[tuple] = []
        if len(held) and len(asking):
            sizes = np.array([len(found[k]) for k in held])
            flat, owner = np.concatenate([found[k] for k in held]), np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for k in asking.tolist():
                a, b = np.searchsorted(flat, found[k], "left"), np.searchsorted(flat, found[k], "right")
                runs = b - a
                at = np.repeat(a - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
                both = np.bincount(owner[at], minlength=len(held))
                near_enough = np.flatnonzero(100 * both >= banding.percent * (sizes + len(found[k]) - both))
                out += [tuple(sorted((nodes[k], nodes[held[j]]))) for j in near_enough.tolist() if nodes[held[j]] != nodes[k]]
        return pa.table([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])

    findable(near.sparkSession)
    return left.union(right).groupBy("main", "i", "j").applyInArrow(links, "a binary, b binary")


def prefix_pairs(mixed_up: DataFrame, texts: DataFrame, banding: Banding, near: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components of open buckets that may be similar enough; none that is is left out.

    Two sets of the wanted similarity share one of the first n - ceil(n * percent / 100) + 1 shingles of either, in any
    common order. Taken from the rarest on, these belong to few sets: what sets a class apart comes first. And they
    share no shingle that only one set has, which bounds what two sets can have in common. Classes near the same
    large component are left to :func:`crowd_links`.
    """
    crowd = near.groupBy("node").agg(F.max(F.struct(F.col("main") == F.col("component"), "main"))["main"].alias("crowd"))
    outside = mixed_up.groupBy("node", "component").agg(F.max(F.col("component") != F.col("main")).alias("outside")).join(crowd, "node", "left")

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch), banding.width)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        return pa.RecordBatch.from_arrays([batch.column("node"), list_column(np.concatenate(sets).view(np.int64), starts, pa.int64())], ["node", "shingles"])

    sets = in_batches(texts.join(outside.select("node"), "node", "left_semi").select("node", "text"), shingles, "node binary, shingles array<bigint>")
    single = stored(sets.select("node", F.explode("shingles").alias("shingle")), "shingles")
    often = single.groupBy("shingle").count()
    placed = single.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("all"))
    size = F.size("all")
    first = size - F.ceil(size * banding.percent / 100).cast("int") + 1
    common = F.size(F.filter("all", lambda s: s["count"] > 1)).cast("long")
    prefix = placed.select("node", size.cast("long").alias("n"), common.alias("common"), F.explode(F.slice("all", F.lit(1), first)).alias("s"))
    # what lies wholly in one set, or shares too little with all others, meets no one
    prefix = prefix.where((F.col("s.count") > 1) & (100 * F.col("common") >= banding.percent * F.col("n")))
    prefix = stored(prefix.join(outside, "node").select("node", "n", "common", "component", "outside", "crowd", F.col("s.shingle").alias("shingle")), "prefixes")
    x = prefix.where("outside").select("shingle", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("m"), F.col("common").alias("common_a"), F.col("crowd").alias("crowd_a"))
    y = prefix.select("shingle", F.col("node").alias("b"), F.col("component").alias("cb"), "n", "common", "crowd")
    room = (100 + banding.percent) * F.least("common", "common_a") >= banding.percent * (F.col("n") + F.col("m"))
    apart = (F.col("ca") != F.col("cb")) & ~F.coalesce(F.col("crowd") == F.col("crowd_a"), F.lit(False))
    met = x.join(y, "shingle").where(apart & _size_fits(banding.percent) & room)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough. ``texts``: (node, text), one text of each class."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for name in ("a", "b"):
            nodes = batch.column(name).to_pylist()
            first = {x: k for k, x in reversed(list(enumerate(nodes)))}
            sets = shingle_sets(texts_of(batch, f"text_{name}").take(pa.array(list(first.values()))), banding.width)
            own = dict(zip(first, sets, strict=True))
            sides.append([own[x] for x in nodes])
        linked = []
        for x, y in zip(*sides, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= banding.percent * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked))

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return in_batches(two.select("a", "b", "text_a", "text_b"), work, "a binary, b binary")


def near_duplicates(df: DataFrame, banding: Banding = Banding(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_shingles, component_id (least id of the component), kept (it is that id)."""
    kind = dict(df.dtypes)[key]
    rows = stored(signatures(df, banding, key, text), "signatures")
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    members = stored(star_pairs(table_keys(classes, banding)), "buckets")
    busy = members.select("node").distinct()
    whose = classes.select("node", "doc_id").join(busy, "node")
    # one text of each class that shares a bucket; several rows of one id and set give the same text
    source = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(whose, "doc_id")
    texts = stored(_matching(source, banding).groupBy("node").agg(F.first("text").alias("text")), "texts")

    star = members.where("node <> leader").where(_size_fits(banding.percent)).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    edges = stored(confirmed(star, texts, banding), "links")
    label = components(edges)
    mixed_up = open_buckets(members, label)
    near = stored(crowded(mixed_up, label), "crowds")
    last = stored(crowd_links(near, texts, banding).union(confirmed(prefix_pairs(mixed_up, texts, banding, near), texts, banding)), "links")
    if not last.isEmpty():
        label = components(edges.union(last))

    named = classes.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "component").select("node", "component_id")
    out = rows.select("doc_id", "node", "n").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").cast(kind).alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _matching(source: DataFrame, banding: Banding) -> DataFrame:
    """(node, text) rows whose text really has that set: a repeated id may come with another text."""
    if "node" not in source.columns:
        raise ValueError("node is missing")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        same = [len(s) > 0 and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == n for s, n in zip(shingle_sets(texts_of(batch), banding.width), batch.column("node").to_pylist(), strict=True)]
        return batch.filter(pa.array(same))

    return in_batches(source.select("node", "text"), work, "node binary, text string")


def drop_near_duplicates(df: DataFrame, banding: Banding = Banding(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all columns, of one document per component. Rows without an id stay: nothing can stand for them.

    Rows that repeat an id and a text count as one document.
    """
    judged = near_duplicates(df, banding, key, text)
    kept = judged.where("kept").select(key).distinct()
    return df.where(F.col(key).isNotNull()).join(kept, key, "left_semi").dropDuplicates([key, text]).select(*df.columns).unionByName(df.where(F.col(key).isNull()))
