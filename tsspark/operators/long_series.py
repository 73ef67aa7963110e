"""One series without an entity, however long: windows, gaps and carries block by block.

A panel is windowed per entity; a single series has nothing to partition by, and one window over it is one task. Here the
rows are dealt by their order into blocks of about ``size`` rows (a range exchange, written once to the shared folder):

- a bounded frame of ``reach`` rows needs the last ``reach`` rows before its block, which are copied in (the halo), from as
  many earlier blocks as it takes;
- an unbounded carry (the last value that is not missing) runs in two passes: the last value of each block, then a prefix
  over the blocks, one value each;
- a gap that spans the end of a block is unfolded up to the first row of the next block.

Only one row per block reaches the driver. Building such a plan runs jobs: the exchange, and one count per block. Missing
dates come first, as in a plain window. Rows whose order columns are all equal keep no defined order among them; give
enough columns to tell rows apart, then many rows of one date are split like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.session import cut_lineage

BLOCK_ROWS = 1_000_000
#: Blocks of a series, as far as ``BLOCK_ROWS`` rows a block allow it: each is a task of every step, which reports to the driver.
MOST_BLOCKS = 500


def block_rows(n_rows: int, size: int) -> int:
    """Rows of a block: ``size``, or as many more, up to ``BLOCK_ROWS``, as keep the number of blocks down."""
    return max(size, min(BLOCK_ROWS, -(-n_rows // MOST_BLOCKS)))


class LongSeries:
    """The rows of one series with the block each belongs to; operators return a new one, so the exchange is shared."""

    def __init__(self, rows: DataFrame, order: Sequence[str]):
        self.rows, self.order = rows, tuple(order)

    @classmethod
    def of(cls, df: DataFrame, order: str | Sequence[str], size: int = BLOCK_ROWS) -> LongSeries:
        """Deal ``df`` into blocks of about ``size`` rows by ``order`` (the date, and what tells equal dates apart).

        A series of more than ``MOST_BLOCKS`` such blocks gets larger ones (``block_rows``).
        """
        order = (order,) if isinstance(order, str) else tuple(order)
        absent = [c for c in order if c not in df.columns]
        if absent:
            raise ValueError(f"Series needs columns {absent}. Found: {df.columns}.")
        n = df.count()
        parts = max(1, -(-n // block_rows(n, size)))
        dealt = df.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in order])
        return cls(cut_lineage(dealt.withColumn("_block", F.spark_partition_id())), order)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "_block"]

    def frame(self) -> DataFrame:
        return self.rows.drop("_block")

    @cached_property
    def sizes(self) -> list[tuple[int, int]]:
        """(block, rows) in order; blocks without a row are left out."""
        counts = self.rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["_block"], r["n"]) for r in counts)

    def _window(self) -> WindowSpec:
        return W.partitionBy("_block").orderBy(*self.order)

    def _halo(self, reach: int) -> DataFrame:
        """Copies of the last rows before each block, under that block's number."""
        wanted = []
        for k, (block, _) in enumerate(self.sizes):
            between = 0  # rows from the end of ``block`` to the block that needs them
            for into, n in self.sizes[k + 1 :]:
                if between >= reach:
                    break
                wanted.append((block, into, reach - between))
                between += n
        newest = W.partitionBy("_block").orderBy(*[F.desc_nulls_last(c) for c in self.order])
        tails = self.rows.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= reach)
        copies = self.rows.sparkSession.createDataFrame(wanted, "_from int, _into int, _most int")  # a few rows per block
        met = tails.join(F.broadcast(copies), (F.col("_block") == F.col("_from")) & (F.col("_back") <= F.col("_most")))
        return met.withColumn("_block", F.col("_into")).select(*self.rows.columns)

    def windowed(self, reach: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> LongSeries:
        """Add window columns that look back at most ``reach`` rows."""
        own = self.rows.withColumn("_own", F.lit(True))
        if reach > 0 and len(self.sizes) > 1:
            own = own.unionByName(self._halo(reach).withColumn("_own", F.lit(False)))
        made = own.withColumns(columns(self._window())).where("_own").drop("_own")
        return self._like(made)

    def _like(self, rows: DataFrame) -> LongSeries:
        """The same rows with more columns."""
        out = LongSeries(rows, self.order)
        out.__dict__["sizes"] = self.sizes
        return out

    def _per_block(self, value: Column, name: str) -> DataFrame:
        """(block, ``name``): a value for each block, from an aggregate that is small."""
        return self.rows.groupBy("_block").agg(value.alias(name))

    def carry_forward(self, column: str, filled: str) -> LongSeries:
        """``filled``: the last value of ``column`` that is not missing; NULL before the first one."""
        value = F.col(column).cast("double")
        order = F.struct(*self.order)
        last = {r["_block"]: r["last"] for r in self._per_block(F.max_by(value, F.when(value.isNotNull(), order)), "last").collect()}
        carried, rows = None, []
        for block, _ in self.sizes:
            rows.append((block, carried))
            carried = carried if last[block] is None else last[block]
        before = self.rows.sparkSession.createDataFrame(rows, "_block int, _carried double")  # a row per block
        past = self._window().rowsBetween(W.unboundedPreceding, 0)
        joined = self.rows.join(F.broadcast(before), "_block")
        own = F.last(value, ignorenulls=True).over(past)
        return self._like(joined.withColumn(filled, F.coalesce(own, F.col("_carried"))).drop("_carried"))

    def unfold(self, target: str, step: Column | None = None) -> LongSeries:
        """Every day (or ``step``) from the first to the last date; only date and target stay, an added day has no target.

        Needs unique dates; rows without a date are left out.
        """
        date = self.order[0]
        narrow = LongSeries(self.rows.where(F.col(date).isNotNull()).select(date, target, "_block"), (date,))
        first = {r["_block"]: r["first"] for r in narrow._per_block(F.min(date), "first").collect()}
        blocks = sorted(first)
        kind = dict(self.rows.dtypes)[date]
        ends = [(b, first[n] if n is not None else None) for b, n in zip(blocks, [*blocks[1:], None], strict=False)]
        after = self.rows.sparkSession.createDataFrame(ends, f"_block int, _after {kind}")  # a row per block
        joined = narrow.rows.join(F.broadcast(after), "_block")
        step = F.make_dt_interval(F.lit(1)) if step is None else step
        placed = joined.withColumn("_after", F.coalesce(F.lead(date).over(narrow._window()), F.col("_after")))
        last = (F.col("_after") - step).cast(kind)
        days = F.sequence(F.col(date), F.greatest(F.coalesce(last, F.col(date)), F.col(date)), step)
        unfolded = placed.select("_block", F.col(date).alias("_own_date"), F.col(target).alias("_value"), F.explode(days).alias(date))
        return LongSeries(unfolded.select(date, F.when(F.col(date) == F.col("_own_date"), F.col("_value")).alias(target), "_block"), (date,))
