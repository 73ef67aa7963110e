"""Licence scan: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

Texts and templates become runs of five-word shingles. A template of s shingles is looked for in windows of W
shingles, W the power of two from 2 s on (4 at least), dealt out every W / 2: whatever stretch of s shingles holds the
template lies whole in one window. Sketches are one-permutation MinHash: the hash range is cut into ``BANDS`` bins,
each bin's least hash is a band of one row. Window and template collide when a bin has the same least hash in both.
The window has at most 4 s shingles, of which a match shares 0.8 s, so the Jaccard similarity is at least 0.19 and a
match is missed with probability at most (1 - 0.19) ** 64 = 1.4e-6; a template with fewer shingles than bins hardly
ever, as its shingles have bins to themselves.

Only windows around a hash that is some template's least one can collide, so the scan looks those hashes up first and
sketches the few windows around them. A candidate is confirmed when the window holds at least ``PERCENT`` of the
template's shingles. Overlapping finds of a template are one, with the best share.

Words are lower-cased and lose marks at their ends; tokens without letters or digits are left out. Templates of under five
words must match word for word, the longest one at a place, and only where no longer find holds them. Null and
empty texts hold nothing. Spans are code points of the text, end exclusive. The templates are a versioned table
(``license_notices``), at most ``MAX_TEMPLATES``; they go to every task. Notices outside the table are not found.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import chained, in_batches, texts_of, word_hashes, word_lists
from tsspark.llm.license_notices import SHORT, TEMPLATES

WIDTH = 5
BANDS = 64
PERCENT = 80
MAX_TEMPLATES = 10_000
_EDGES = ".,;:!?\"'`()[]{}<>#*$%&|~^_=+/\\-@"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
FOUND = "array<struct<license:string,start:int,stop:int,percent:int>>"
_KIND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("percent", pa.int32())]))

def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words that count, where each text's begin, and for each the place among all tokens of its text."""
    words, starts = word_lists(texts, lower=False)
    coded = words.dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _EDGES)
    index = coded.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0)[index] if len(index) else np.empty(0, bool)
    place = np.arange(len(index)) - np.repeat(starts[:-1], np.diff(starts))
    hashes = word_hashes(plain)[index] if len(index) else np.empty(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(real)))[starts]
    return hashes[real], at, place[real]


class Template(NamedTuple):
    name: str
    shingles: np.ndarray
    window: int


class Finder:
    def __init__(self, templates: dict[str, str], bands: int = BANDS, percent: int = PERCENT):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"{len(templates)} templates; at most {MAX_TEMPLATES} are taken.")
        self.bands, self.percent, self.templates, self.least, self.short = np.uint64(bands), percent, [], {}, {}
        for name, text in sorted(templates.items()):
            hashes, _, _ = _tokens(pa.array([text], pa.large_string()))
            if not len(hashes):
                raise ValueError(f"{name} has no words.")
            if len(hashes) < WIDTH:
                self.short.setdefault(tuple(hashes.tolist()), len(self.templates))
                self.templates.append(Template(name, hashes[:0], 0))
                continue
            own = np.unique(chained(hashes, WIDTH))
            run = len(hashes) - WIDTH + 1
            for value in self._sketch(own).values():
                self.least.setdefault(value, []).append(len(self.templates))
            self.templates.append(Template(name, own, max(4, 1 << (2 * run - 1).bit_length())))
        self.values = np.sort(np.array(list(self.least), np.uint64))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.first = np.zeros(1 << 20, bool)
        self.first[[words[0] & ((1 << 20) - 1) for words in self.short]] = True

    def _sketch(self, shingles: np.ndarray) -> dict[int, int]:
        """The least hash of each bin that has one."""
        bins, out = (shingles % self.bands).tolist(), {}
        for b, h in zip(bins, shingles.tolist(), strict=True):
            out[b] = min(h, out.get(b, h))
        return out

    def find(self, texts: pa.Array) -> list[list[dict]]:
        hashes, at, place = _tokens(texts)
        found: list[dict[int, list]] = [{} for _ in range(len(texts))]
        shingles = chained(hashes, WIDTH)
        hits = np.flatnonzero(self.filter[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        hits = hits[np.isin(shingles[hits], self.values)]
        row = np.searchsorted(at, hits, side="right") - 1
        inside = hits + WIDTH <= at[row + 1]  # a shingle ends in the text it begins in
        tried = set()
        for hit, r in zip(hits[inside].tolist(), row[inside].tolist(), strict=True):
            first, count = int(at[r]), int(at[r + 1] - at[r]) - WIDTH + 1
            for number in self.least[int(shingles[hit])]:
                t = self.templates[number]
                step = t.window // 2
                for start in {max(0, (hit - first) // step - 1) * step, (hit - first) // step * step}:
                    if (r, number, start) in tried or start + t.window <= hit - first:
                        continue
                    tried.add((r, number, start))
                    own = shingles[first + start : first + min(start + t.window, count)]
                    sketch = self._sketch(own)
                    if not any(sketch.get(b) == v for b, v in self._sketch(t.shingles).items()):
                        continue
                    shared = np.flatnonzero(np.isin(own, t.shingles))
                    percent = 100 * len(np.unique(own[shared])) // len(t.shingles)
                    if percent >= self.percent:
                        found[r].setdefault(number, []).append((start + int(shared[0]), start + int(shared[-1]) + WIDTH, percent))
        self._find_short(hashes, at, found)
        return [self._spans(x, texts[r].as_py(), place[at[r] : at[r + 1]]) if x else [] for r, x in enumerate(found)]

    def _find_short(self, hashes: np.ndarray, at: np.ndarray, found: list[dict[int, list]]) -> None:
        hits = np.flatnonzero(self.first[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        row = np.searchsorted(at, hits, side="right") - 1
        held = {}
        for hit, r in zip(hits.tolist(), row.tolist(), strict=True):
            if r not in held:
                held[r] = [span for spans in found[r].values() for span in spans]
            words, a = tuple(hashes[hit : min(hit + WIDTH - 1, int(at[r + 1]))].tolist()), hit - int(at[r])
            size = next((n for n in range(len(words), 0, -1) if words[:n] in self.short), 0)
            if size and not any(x <= a and a + size <= y for x, y, _ in held[r]):
                found[r].setdefault(self.short[words[:size]], []).append((a, a + size, 100))
                held[r].append((a, a + size, 100))

    def _spans(self, found: dict[int, list], text: str, place: np.ndarray) -> list[dict]:
        words = [m.span() for m in _TOKEN.finditer(text)]
        out = []
        for number, spans in found.items():
            merged: list[list] = []
            for a, b, percent in sorted(spans):
                if merged and a < merged[-1][1]:
                    merged[-1] = [merged[-1][0], max(b, merged[-1][1]), max(percent, merged[-1][2])]
                else:
                    merged.append([a, b, percent])
            out += [{"license": self.templates[number].name, "start": words[place[a]][0], "stop": words[place[b - 1]][1], "percent": p} for a, b, p in merged]
        return sorted(out, key=lambda x: (x["start"], x["license"]))


def find(df: DataFrame, templates: dict[str, str] = TEMPLATES | SHORT, text: str = "text", column: str = "licenses") -> DataFrame:
    """The rows, all columns, and ``column``: the licences found, with span and share of the template. No shuffle."""
    finder = Finder(templates)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(column, pa.array(finder.find(texts_of(batch, text)), _KIND))

    return in_batches(df, work, df.withColumn(column, F.array().cast(FOUND)).schema)


def judged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, number of finds, the distinct licences by name, the finds by shingles, and the notices word for word."""
    found = find(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    short = lambda x: x["license"].isin(list(SHORT))
    return found.select(
        F.col("key").alias(key),
        F.size("licenses").cast("long").alias("n_found"),
        F.array_join(names, ",").alias("names"),
        F.filter("licenses", lambda x: ~short(x)).alias("finds"),
        F.filter("licenses", short).alias("notices"),
    )
