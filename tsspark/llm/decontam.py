"""Benchmark passages in documents, up to a share of edits.

An item of m characters may differ by k = floor(m * rate) edits. It is split into k + 1 pieces: k edits leave one
piece untouched (pigeonhole), so every passage within the budget holds an exact piece at about its place. One
automaton finds all pieces of all items in one scan of a text. Around each hit the window that the passage must
lie in is checked, first by shared trigrams (k edits destroy at most 3 * k of them), then by Myers' bit-parallel edit
distance, which gives the least distance of the whole item to any stretch of the window. Both steps are exact:
nothing within the budget is missed, nothing beyond it is reported.

Texts and items are lower-cased and their runs of white space become one blank; places refer to that form. Items
of under ``LEAST_CHARS`` characters have no budget and must stand at word borders; scripts written without blanks have
a border everywhere. Only items without an id, null and blank ones are left out (``left_out``). Null and empty texts hold nothing.
Equal items are reported each under its own id. The items go to the tasks in parts of at most ``PART_CHARS``
characters, each part a scan of its own, so a benchmark of any size is handled in bounded memory.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import in_batches, texts_of

RATE = 0.1
#: Items below this are matched exactly.
LEAST_CHARS = 20
#: Thai, Lao, Burmese, Khmer, kana and Han.
_NO_BLANKS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: Characters of items in one automaton.
PART_CHARS = 4_000_000
GRAM = 3
FOUND = "array<struct<item_id:bigint,distance:int,stop:int>>"


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def _border(before: str, after: str) -> bool:
    """Whether a word may end between two neighbouring characters; either is empty at an end of the text."""
    if not before or not after or _NO_BLANKS.match(before) or _NO_BLANKS.match(after):
        return True
    return not (after.isalnum() and (before.isalnum() or unicodedata.combining(before)) or unicodedata.combining(after))


def pieces(text: str, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` stretches of nearly equal length that cover the text."""
    n = budget + 1
    return [(len(text) * j // n, len(text) * (j + 1) // n) for j in range(n)]


def edit_distance_within(item: str, window: str) -> tuple[int, int]:
    """Least edit distance of the whole item to any stretch of the window, and the first place where it ends.

    Myers' recurrence, one arithmetic step per character of the window; the bit vectors are as long as the item.
    """
    masks: dict[str, int] = defaultdict(int)
    for k, char in enumerate(item):
        masks[char] |= 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best, stop = full, 0, len(item), len(item), 0
    for place, char in enumerate(window, 1):
        equal = masks.get(char, 0)
        vertical = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, stop = score, place
    return best, stop


class Matcher:
    """The automaton over the pieces of a part of the items; ``items``: (id, plain text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate) if len(t) >= LEAST_CHARS else 0, Counter(t[k : k + GRAM] for k in range(len(t) - GRAM + 1))) for i, t in items]
        places: dict[str, list] = defaultdict(list)
        for number, (_, text, budget, _) in enumerate(self.items):
            for a, b in pieces(text, budget):
                places[text[a:b]].append((number, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """Items with their least distance in the text and where that match ends."""
        best: dict[int, tuple[int, int]] = {}
        tried = set()
        if not self.items or not text:
            return []
        for last, where in self.automaton.iter(text):
            for number, offset in where:
                item_id, item, budget, grams = self.items[number]
                start = last + 1 - offset
                if (number, start) in tried or best.get(number, (1,))[0] == 0:
                    continue
                tried.add((number, start))
                low = max(0, start - budget)
                window = text[low : start + len(item) + budget]
                if window[start - low : start - low + len(item)] == item and start >= 0:
                    stop = start + len(item)
                    if len(item) >= LEAST_CHARS or _border(text[max(0, start - 1) : start], item[0]) and _border(item[-1], text[stop : stop + 1]):
                        best[number] = (0, stop)
                    continue
                shared = 0
                left = dict(grams)
                for k in range(len(window) - GRAM + 1):
                    g = window[k : k + GRAM]
                    if left.get(g, 0):
                        left[g] -= 1
                        shared += 1
                if shared < len(item) - GRAM + 1 - GRAM * budget:
                    continue
                distance, stop = edit_distance_within(item, window)
                if distance <= budget and (distance, low + stop) < best.get(number, (budget + 1, 0)):
                    best[number] = (distance, low + stop)
        return sorted(({"item_id": self.items[n][0], "distance": d, "stop": s} for n, (d, s) in best.items()), key=lambda x: x["item_id"])


@lru_cache(maxsize=2)
def _matcher(items: tuple, rate: float) -> Matcher:
    return Matcher(list(items), rate)


def item_parts(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> list[tuple]:
    """The items in plain form, in parts of bounded size; blank ones are left out."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.char_length("t"))).first()[0] or 0
    count = 1 + 2 * total // PART_CHARS if total > PART_CHARS else 1
    out = []
    for part in range(count):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == part).collect()
        found = sorted((r["i"], plain(r["t"])) for r in own)
        out.append(tuple((i, t) for i, t in found if t))
    return out


def left_out(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of the benchmark that are looked for in no document: those without an id, null and blank ones."""
    return benchmark.where(F.col(item).cast("long").isNull() | ~F.coalesce(F.col(text).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False)))


def matches(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", column: str = "matches") -> DataFrame:
    """The documents, all columns, and ``column``: the items found, by id, with distance and end. No shuffle."""
    out = documents.withColumn(column, F.array().cast(FOUND))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("stop", pa.int32())]))
    for items in item_parts(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            finder = _matcher(shared.value, rate)
            place = batch.schema.get_field_index(column)
            before = batch.column(place).to_pylist()
            found = [sorted(old + finder.find(plain(t)), key=lambda x: x["item_id"]) for old, t in zip(before, texts_of(batch, text).to_pylist(), strict=True)]
            return batch.set_column(place, column, pa.array(found, kind))

        out = in_batches(out, work, out.schema)
    return out


def judged(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, contaminated, the items found, their number and the least distance (null without any)."""
    found = matches(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark)
    ids = F.array_distinct(F.transform("matches", lambda x: x["item_id"]))
    return found.select(
        F.col("key").alias(key),
        (F.size("matches") > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.array_min(F.transform("matches", lambda x: x["distance"])).alias("least_distance"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, that hold no item."""
    return matches(documents, benchmark, text=text, column="__matches").where(F.size("__matches") == 0).drop("__matches")
