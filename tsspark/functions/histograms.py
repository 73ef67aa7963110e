"""What the tasks of a tree fit do: sums by node and bin of rows on their own disk. NumPy only, as every worker loads it.

A row holds codes, each the bins of one column or of a few columns together, a bundle; so a row costs one addition per bundle.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

#: A tree as it travels: per node its bundle (-1: a leaf), its column's place there, which bins go left, both children, value.
Flat = list[tuple[int, int, "np.ndarray | None", int, int, float]]
#: The same with the codes that go left, in place of the bins.
Ready = list[tuple[int, "np.ndarray | None", int, int, float]]
#: Codes by bundle, and labels.
Chunk = tuple[np.ndarray, np.ndarray]


def ready(tree: Flat, bundles: Sequence[Sequence[int]]) -> Ready:
    out = []
    for bundle, at, lefts, left, right, value in tree:
        if bundle >= 0:
            own = [-1 if k == at else 1 for k in range(len(bundles[bundle]))]
            lefts = np.broadcast_to(lefts.reshape(own), bundles[bundle]).ravel()
        out.append((bundle, lefts, left, right, value))
    return out


def leaves(codes: np.ndarray, tree: Ready) -> Iterator[tuple[int, np.ndarray | None]]:
    """The leaves of a tree, each with the places of its rows; None stands for all rows."""
    todo = [(0, None)]
    while todo:
        node, rows = todo.pop()
        bundle, lefts, left, right, _ = tree[node]
        if bundle < 0:
            yield node, rows
            continue
        goes = lefts.take(codes[bundle] if rows is None else codes[bundle].take(rows))
        for child, side in ((right, np.flatnonzero(~goes)), (left, np.flatnonzero(goes))):
            todo.append((child, side if rows is None else rows.take(side)))


def add_trees(made: np.ndarray, codes: np.ndarray, trees: Sequence[Ready], weights: Sequence[float]) -> None:
    for tree, weight in zip(trees, weights, strict=True):
        for node, rows in leaves(codes, tree):
            if rows is None:
                made += tree[node][4] * weight
            else:
                made[rows] += tree[node][4] * weight


def add_up(total: np.ndarray, codes: np.ndarray, sizes: Sequence[int], residual: np.ndarray, groups: Sequence[tuple[int, np.ndarray | None]]) -> None:
    """Add count, sum and sum of squares of the residuals, by group and code, to ``total`` (3, groups, codes of all bundles)."""
    groups = [g for g in groups if g[1] is None or len(g[1])]
    if not groups:
        return
    n, whole = total.shape[1], groups[0][1] is None
    rows = None if whole else np.concatenate([r for _, r in groups])
    group = None if n == 1 else np.repeat([g for g, _ in groups], [codes.shape[1] if whole else len(r) for _, r in groups])
    own = residual if whole else residual.take(rows)
    weights, at = (None, own, own * own), 0
    for code, size in zip(codes, sizes, strict=True):
        place = (code if whole else code.take(rows)).astype(np.intp)
        if group is not None:
            place += group * size
        for s, w in enumerate(weights):
            total[s, :, at : at + size] += np.bincount(place, w, n * size).reshape(n, size)
        at += size


def unbundled(total: np.ndarray, bundles: Sequence[Sequence[int]]) -> np.ndarray:
    """Sums by bin, one column after the other, from sums by code; ``bundles`` has the number of bins of each bundle's columns."""
    out, at = [], 0
    for sizes in bundles:
        size = int(np.prod(sizes))
        block = total[:, :, at : at + size].reshape(*total.shape[:2], *sizes)
        axes = range(2, 2 + len(sizes))
        out += [block.sum(axis=tuple(a for a in axes if a != own)) if len(sizes) > 1 else block for own in axes]
        at += size
    return np.concatenate(out, axis=2)


# ---- files on the executor's own disk ----------------------------------------------------------------


def own_folder() -> str:
    """A folder below those that Spark gives its executor and removes with it."""
    folder = os.path.join(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0], "trees")
    os.makedirs(folder, exist_ok=True)
    return folder


@contextmanager
def whole_file(name: str) -> Iterator[BinaryIO]:
    """A file in the own folder that is there when it is complete, or not at all."""
    fresh = tempfile.NamedTemporaryFile(dir=own_folder(), prefix=f"{name}-", delete=False)
    try:
        with fresh:
            yield fresh
        os.replace(fresh.name, os.path.join(own_folder(), name))
    except BaseException:
        with suppress(FileNotFoundError):
            os.remove(fresh.name)
        raise


def forget(fit: str) -> None:
    """Remove a fit's files from this executor."""
    for name in os.listdir(own_folder()):
        if name.startswith(f"{fit}-"):
            with suppress(FileNotFoundError):
                os.remove(os.path.join(own_folder(), name))


def keep(fit: str, part: int, chunks: Iterator[Chunk]) -> list[int]:
    """Write the rows of a partition to the own disk, and give the lengths of their chunks."""
    lengths = []
    with whole_file(f"{fit}-{part}-rows") as file:
        for codes, labels in chunks:
            codes.tofile(file)
            labels.tofile(file)
            lengths.append(len(labels))
    return lengths


@dataclass(frozen=True)
class Pass:
    """What the tasks of one pass need: all finished trees, pickled as mostly the last one is read only, the growing one, and
    which of its leaves are added up."""

    fit: str
    bundles: list[list[int]]
    trees: list[bytes]
    weights: list[float]
    growing: Flat
    wanted: dict[int, int]

    def run(self, kept: Iterator[tuple[int, str, list[int]]]) -> Iterator[tuple[int, np.ndarray | None]]:
        """(partition, sums) of the rows on this disk; no sums if they are not here."""
        n = len(self.bundles)
        for part, kind, lengths in list(kept):
            try:
                file = open(os.path.join(own_folder(), f"{self.fit}-{part}-rows"), "rb")  # noqa: SIM115
            except FileNotFoundError:
                yield part, None
                continue
            with file:
                yield part, self._sums(part, ((np.fromfile(file, kind, n * rows).reshape(n, rows), np.fromfile(file, count=rows)) for rows in lengths))

    def _name(self, part: int, version: int) -> str:
        return f"{self.fit}-{part}-{version}"

    def _known(self, part: int) -> int:
        """The newest version of the forecasts on this disk, 0 if there is none."""
        there = set(os.listdir(own_folder()))
        return next((v for v in range(len(self.trees), 0, -1) if self._name(part, v) in there), 0)

    def _sums(self, part: int, chunks: Iterator[Chunk]) -> np.ndarray:
        now, known = len(self.trees), self._known(part)
        sizes = [int(np.prod(b)) for b in self.bundles]
        total = np.zeros((3, len(self.wanted), sum(sizes)))
        newer = [ready(pickle.loads(tree), self.bundles) for tree in self.trees[known:]]
        growing = ready(self.growing, self.bundles)

        def add(old: BinaryIO, new: BinaryIO | None) -> None:
            for codes, labels in chunks:
                residual = labels
                if now:
                    made = np.fromfile(old, count=len(labels)) if known else np.zeros(len(labels))
                    add_trees(made, codes, newer, self.weights[known:])
                    residual = 2.0 * (labels - made)
                    if new:
                        made.tofile(new)
                groups = [(self.wanted[node], rows) for node, rows in leaves(codes, growing) if node in self.wanted]
                add_up(total, codes, sizes, residual, groups)

        with open(os.path.join(own_folder(), self._name(part, known)) if known else os.devnull, "rb") as old:
            if known == now:
                add(old, None)
            else:
                with whole_file(self._name(part, now)) as new:
                    add(old, new)
                with suppress(FileNotFoundError):
                    os.remove(os.path.join(own_folder(), self._name(part, now - 2)))
        return unbundled(total, self.bundles)
