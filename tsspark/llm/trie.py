"""The prefix trie of conversations, by a skeleton of splitters: what chats share, and what a prefix cache would save.

A turn becomes a token of fixed width: a digest of role and text, and the length of the text. A conversation is the string
of its tokens, so string order is trie order. Splitters taken from a sample of these strings cut them into sorted shards.
Every prefix of a splitter belongs to the skeleton, a small trie that all tasks know. A node with members in two shards
lies between strings on both sides of a splitter, so it is a prefix of that splitter and in the skeleton; every other node
lies in one shard, and the sorted shard finishes it with a stack of open nodes. Skeleton nodes send partial aggregates,
one row per shard, that are summed up and rolled up along the skeleton, which is bounded by ``SKELETON_CHARS``.

Equal conversations are grouped before they meet the shards: one row per distinct string and ``CHUNK`` neighbouring ids.
The ids of a string are hashed chunk by chunk in order, as SHA-256 can't be merged; a very common string costs its task
one row per chunk, and constant memory. One conversation's tokens (24 bytes a turn) are held by one task.

Turns are ordered by number, null first, equal numbers by role, then by their token; null roles and texts are empty;
repeated rows are turns of their own. Rows without a conversation id belong to no conversation and are left out. An empty
table has no nodes. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import findable, stored, text_or_empty

#: Characters of a token: 18 bytes, of which 14 are the digest and 4 the length in code points.
WIDTH = 24
#: Conversations whose ids share all but the last bits (1024 neighbours) are grouped into one row per string.
CHUNK_BITS = 10
#: Strings a shard holds, about; splitters look at so many turns; conversations equal so far share a shard, whatever its size.
SHARD_ROWS, SPLIT_TURNS, MAX_SHARDS = 100_000, 32, 2048
#: Sampled strings per shard, and the size of all splitters together.
SAMPLED, SKELETON_CHARS = 16, 4_000_000
NOTHING = hashlib.sha256(b"").hexdigest()


def tokens(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, token) of every turn that belongs to a conversation."""
    said = F.concat(F.char_length(text_or_empty(role)).cast("string"), F.lit(":"), text_or_empty(role), text_or_empty(text))
    digest = F.unhex(F.substring(F.sha2(said, 256), 1, 28))
    length = F.unhex(F.lpad(F.hex(F.char_length(text_or_empty(text))), 8, "0"))
    named = [F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), text_or_empty(role).alias("role")]
    return turns.where(F.col(conv).isNotNull()).select(*named, F.base64(F.concat(digest, length)).alias("token"))


def _ordered() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "token"))), lambda t: t["token"]).alias("tokens")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation."""
    own = tokens(turns).groupBy("conv_id").agg(_ordered())
    return own.select("conv_id", F.array_join("tokens", "").alias("path"))


def branched_paths(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, path) where each conversation begins with turns of the first one of its block of ids.

    Conversation c takes the first h turns of conversation c - c % block, and its own turns after its first h, with
    h = crc32(c) % most. A block is at most ``2 * block - 1`` conversations, and is the unit that the exchange keeps together.
    """
    base = F.col("conv_id") - F.col("conv_id") % block
    own = tokens(turns).withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(_ordered())
    heads = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("tokens", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    path = F.concat(head, F.slice("tokens", h + 1, F.greatest(F.size("tokens"), F.lit(1))))
    return own.join(heads, "base", "left").select("conv_id", F.array_join(path, "").alias("path"))


class Skeleton:
    """The trie of all prefixes of the splitters; node 0 is the root, a node comes after its parent."""

    def __init__(self, splitters: list[str]):
        self.splitters = splitters
        self.parent, self.depth, self.length, self.token = [-1], [0], [0], [""]
        self.children: list[dict[str, int]] = [{}]
        for s in splitters:
            at = 0
            for k in range(0, len(s), WIDTH):
                token = s[k : k + WIDTH]
                if token not in self.children[at]:
                    self.children[at][token] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(k // WIDTH + 1)
                    self.length.append(text_length(token))
                    self.token.append(token)
                    self.children.append({})
                at = self.children[at][token]


def text_length(token: str) -> int:
    return int.from_bytes(b64decode(token)[14:], "big")


def shared_turns(a: str, b: str) -> int:
    """Whole tokens that two strings have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    k = 0
    while a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


def pick_splitters(sample: list[str], shards: int, most_chars: int = SKELETON_CHARS) -> list[str]:
    """Up to shards - 1 splitters at equal distances in the sample, each cut after the turn that tells it from its neighbour."""
    sample = sorted(sample)
    step = len(sample) / max(shards, 1)
    places = sorted({int(k * step) for k in range(1, shards)} - {0}) if len(sample) > 1 else []
    found = {sample[p][: WIDTH * (shared_turns(sample[p - 1], sample[p]) + 1)] for p in places if sample[p - 1] != sample[p]}
    splitters = sorted(found)
    while sum(map(len, splitters)) > most_chars:
        splitters = splitters[1::2]  # fewer and larger shards
    return splitters


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id string"
PART = f"{NODE}, above int, bone int"


class _Open:
    """A node on the stack."""

    __slots__ = ("bone", "token", "n", "least", "children", "leaves", "saved", "ends", "finished")

    def __init__(self, bone: int | None, token: str):
        self.bone, self.token = bone, token
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, None
        self.finished: list[tuple] = []  # children that wait for this node's smallest member


def shard_nodes(rows: Iterator[tuple], skeleton: Skeleton) -> Iterator[tuple]:
    """Nodes of sorted (shard, path, n, least, ids) rows, in the columns of ``PART``: finished ones, and parts of skeleton nodes."""
    stack: list[_Open] = []
    path, shard = None, None

    def close(down_to: int) -> Iterator[tuple]:
        while len(stack) > down_to:
            node, depth = stack.pop(), len(stack)
            above = stack[-1] if stack else None
            ends = node.ends.hexdigest() if node.ends else None
            if node.bone is None:
                leaves = node.leaves if node.children else 1
                saved = node.saved + (node.n - 1) * text_length(node.token)
                for child in node.finished:
                    yield (*child[:2], node.least, *child[2:], None, None)
                row = (node.least, depth, node.n, node.children, leaves, saved, ends or NOTHING, node.token)
                above.children += 1
                above.leaves += leaves
                above.saved += saved
                if above.bone is None:
                    above.finished.append(row)
                else:
                    yield (*row[:2], None, *row[2:], above.bone, None)
            else:
                yield (node.least, depth, None, node.n, node.children, node.leaves, node.saved, ends, node.token, None, node.bone)
            if above is not None:
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)

    for part, own, n, least, ids in rows:
        if part != shard:
            yield from close(0)
            stack.append(_Open(0, ""))
            path, shard = None, part
        if own != path:
            same = shared_turns(path, own) if path is not None else 0
            yield from close(same + 1)
            for k in range(same * WIDTH, len(own), WIDTH):
                token, bone = own[k : k + WIDTH], stack[-1].bone
                stack.append(_Open(skeleton.children[bone].get(token) if bone is not None else None, token))
            path = own
        top = stack[-1]
        top.n += n
        top.least = least if top.least is None else min(top.least, least)
        if top.ends is None:
            top.ends = hashlib.sha256()
        else:
            top.ends.update(b",")
        top.ends.update(ids.encode())
    yield from close(0)


def _arrow_part() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in PART.split(", "))])


def _batched(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    schema, held = _arrow_part(), []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def grouped(rebuilt: DataFrame) -> DataFrame:
    """(path, chunk, n, least, ids): equal conversations of neighbouring ids as one row; ids ascend, joined by commas."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",")
    own = rebuilt.groupBy("path", chunk.alias("chunk"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))


def _sample(rows: DataFrame, total: int, shards: int) -> list[str]:
    """Beginnings of about ``SAMPLED`` strings per shard."""
    rate = max(1, total // (SAMPLED * shards))
    picked = rows.where(F.pmod(F.xxhash64("path", "chunk"), F.lit(rate)) == 0)
    return [r[0] for r in picked.select(F.substring("path", 1, WIDTH * SPLIT_TURNS)).collect()]


def rolled_up(parts: dict[int, list], skeleton: Skeleton) -> list[tuple]:
    """Finished skeleton nodes from the sums of their parts, children before parents."""
    done: dict[int, tuple] = {}
    for bone in range(len(skeleton.parent) - 1, -1, -1):
        if bone not in parts:
            continue
        n, least, children, leaves, saved, ends = parts[bone]
        leaves = leaves if children else 1
        saved += (n - 1) * skeleton.length[bone]
        done[bone] = (least, n, children, leaves, saved, ends or NOTHING)
        if bone:
            above = parts[skeleton.parent[bone]]
            above[2] += 1
            above[3] += leaves
            above[4] += saved
    rows = []
    for bone, (least, *rest, ends) in done.items():
        parent = done[skeleton.parent[bone]][0] if bone else None
        rows.append((least, skeleton.depth[bone], parent, *rest, ends, skeleton.token[bone]))
    return rows


def prefix_trie(rebuilt: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of (conv_id, path) rows, in the columns of ``NODE``.

    ``conv_id`` is the smallest member, ``turn_id`` the token of the node's last turn (see ``with_texts``).
    """
    spark = rebuilt.sparkSession
    findable(spark)
    rows = stored(grouped(rebuilt), "paths")
    total = rows.count()
    if shards is None:
        shards = min(MAX_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS)))
    splitters = pick_splitters(_sample(rows, total, shards), shards)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series) -> pd.Series:
        return path.map(lambda p: bisect_right(splitters, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "n", "least", "ids")), strict=True)

        yield from _batched(shard_nodes(flat(), Skeleton(splitters)))

    dealt = rows.withColumn("shard", shard_of("path")).repartitionById(len(splitters) + 1, F.col("shard"))
    nodes = stored(dealt.sortWithinPartitions("shard", "path", "chunk").drop("chunk").mapInArrow(run, PART), "nodes")

    sums = [F.sum("n_convs"), F.min("conv_id"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("ends_sha256")]
    parts = {r[0]: list(r[1:]) for r in nodes.where(F.col("bone").isNotNull()).groupBy("bone").agg(*sums).collect()}  # bounded by the skeleton
    bones = rolled_up(parts, Skeleton(splitters))
    least = spark.createDataFrame([(b, p[1]) for b, p in parts.items()], "above int, above_conv_id long")
    local = nodes.where(F.col("bone").isNull()).join(F.broadcast(least), "above", "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id"))
    names = [x.split(" ")[0] for x in NODE.split(", ")]
    return local.select(*names).unionByName(spark.createDataFrame(bones, NODE))


def with_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the ``role`` and ``text`` of their last turn; null for the root."""
    said = tokens(turns.withColumns({"__role": text_or_empty("role"), "__text": text_or_empty("text")}), turn="__text", role="__role")
    said = said.select(F.col("token").alias("turn_id"), "role", F.col("turn").alias("text"))
    return nodes.join(said.groupBy("turn_id").agg(F.first("role").alias("role"), F.first("text").alias("text")), "turn_id", "left")
