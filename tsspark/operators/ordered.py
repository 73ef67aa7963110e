"""Exact order statistics without a global sort.

Values are counted first (a partial aggregate, so a hot value is one row per task), the distinct values
are put into a few hundred buckets of similar size by an approximate-quantile sketch, and only bucket
totals are ever ordered globally. The sketch decides the balance of the work, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.session import cut_lineage

FAN = 16
BUCKETS = FAN * FAN
SKETCH_ACCURACY = 10 * BUCKETS


def edges_passed(value: Column, edges: Column) -> Column:
    """How many entries of the ascending array ``edges`` are <= value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def _sketch(value: Column) -> Column:
    shares = np.arange(1, BUCKETS) / BUCKETS  # one array literal
    return F.call_function("percentile_approx", value, F.lit(shares), F.lit(SKETCH_ACCURACY))


def _every_fan_th(edges: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(FAN - 1)), lambda j: F.get(edges, j * FAN - 1))


def _bucket(value: Column, edges: Column, coarse: Column) -> Column:
    """Two short scans (coarse, then fine) instead of one over all edges."""
    c = edges_passed(value, coarse)
    return c * FAN + edges_passed(value, F.slice(edges, c * FAN + 1, F.lit(FAN - 1)))


def bucketed_counts(counts: DataFrame, by: str | None = None, value: str = "value") -> DataFrame:
    """Add ``bucket`` to a table of distinct values. ``by`` must name a bounded set (feature names)."""
    sketch = counts.groupBy(*([by] if by else [])).agg(_sketch(F.col(value)).alias("edges"))
    if by:
        sketch = sketch.withColumn("coarse", _every_fan_th(F.col("edges")))
        placed = counts.join(sketch, by)  # Spark chooses by size
        bucket = _bucket(F.col(value), F.col("edges"), F.col("coarse"))
        return placed.withColumn("bucket", bucket).drop("edges", "coarse")
    packed = sketch.select(F.struct("edges", _every_fan_th(F.col("edges")).alias("coarse")))
    placed = counts.withColumn("sketch", packed.scalar())
    bucket = _bucket(F.col(value), F.col("sketch.edges"), F.col("sketch.coarse"))
    return placed.withColumn("bucket", bucket).drop("sketch")


def exact_quantiles(
    df: DataFrame, value: str, shares: Sequence[float], weight: str | None = None
) -> DataFrame:
    """One row, ``quantiles array<double>``: linear interpolation between neighbours, NULLs left out.

    ``weight`` counts a row several times (whole numbers). No row at all gives NULL entries. Runs one
    job: the value counts are written to the shared folder, so what lies before them is computed once.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("value"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("bigint").alias("w"))
    )
    placed = bucketed_counts(cut_lineage(counts))

    # at most BUCKETS rows from here on
    totals = placed.groupBy("bucket").agg(F.sum("w").alias("held"))
    everything = W.partitionBy(F.lit(0))
    in_order = everything.orderBy("bucket")
    totals = totals.select(
        "bucket",
        "held",
        (F.sum("held").over(in_order) - F.col("held")).alias("before"),
        F.sum("held").over(everything).alias("n"),
    )
    position = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in position for f in (F.floor, F.ceil)]))
    held_here = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")))
    wanted = totals.select("bucket", "before", "n", held_here.alias("ranks")).where(F.size("ranks") > 0)

    # at most two buckets per share are opened; `wanted` has no more rows than that
    inside = placed.join(F.broadcast(wanted), "bucket")
    upto = F.col("before") + F.sum("w").over(W.partitionBy("bucket").orderBy("value"))
    picked = inside.select("value", "w", "n", "ranks", upto.alias("upto")).select(
        "value", "n", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("w")))).alias("rank")
    )
    found = picked.agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("at"), F.max("n").alias("n"))
    return found.select(F.array(*[_interpolate(p) for p in shares]).alias("quantiles"))


def _interpolate(share: float) -> Column:
    at = F.col("at")
    position = F.lit(float(share)) * (F.col("n") - 1)
    low = F.try_element_at(at, F.floor(position).cast("bigint"))
    high = F.try_element_at(at, F.ceil(position).cast("bigint"))
    return low + (high - low) * (position - F.floor(position))


def _entity_key(entity: str) -> Column:
    return F.md5(F.col(entity).cast("string"))


def date_counts(df: DataFrame, date: str = "date", entity: str = "entity") -> DataFrame:
    """Rows per (date, first two digits of the entity's md5): at most 256 rows per calendar day.

    Runs one job; the small table is written to the shared folder.
    """
    prefix = F.substring(_entity_key(entity), 1, 2).alias("prefix")
    return cut_lineage(df.groupBy(F.col(date).alias("date"), prefix).agg(F.count(F.lit(1)).alias("rows")))


def _containing(table: DataFrame, order: str, index: Column) -> Column:
    """Which value of ``order`` covers the row at ``index`` (from 0), and how many of its rows precede it."""
    everything = W.partitionBy(F.lit(0))
    counted = table.select(
        order,
        "rows",
        (F.sum("rows").over(everything.orderBy(order)) - F.col("rows")).alias("before"),
        F.sum("rows").over(everything).alias("n"),
    )
    hit = (F.col("before") <= index) & (index < F.col("before") + F.col("rows"))
    return counted.where(hit).select(F.struct(F.col(order).alias("at"), (index - F.col("before")).alias("skip"))).scalar()


def half_split(
    df: DataFrame, date: str = "date", entity: str = "entity", column: str = "half", counts: DataFrame | None = None
) -> DataFrame:
    """Label the first ``n // 2`` rows in date order ``reference`` and the rest ``current``.

    Rows of one date are ordered by the md5 of their entity. ``date_counts`` locates the boundary date and
    the md5 prefix inside it, so the only rows ever ranked are those of one prefix on one date. Needs
    unique (entity, date).
    """
    key = _entity_key(entity)
    counts = date_counts(df, date, entity) if counts is None else counts
    per_date = counts.groupBy("date").agg(F.sum("rows").alias("rows"))
    day = _containing(per_date, "date", F.floor(F.col("n") / 2))
    sliver = _containing(counts.where(F.col("date") == day["at"]), "prefix", day["skip"])
    ranked = df.where((F.col(date) == day["at"]) & (F.substring(key, 1, 2) == sliver["at"])).select(
        key.alias("key"), F.row_number().over(W.partitionBy(F.substring(key, 1, 2)).orderBy(key)).alias("rank")
    )
    first_current = ranked.where(F.col("rank") == sliver["skip"] + 1).select("key").scalar()
    late = (F.col(date) > day["at"]) | ((F.col(date) == day["at"]) & (key >= first_current))
    return df.withColumn(column, F.when(late, F.lit("current")).otherwise(F.lit("reference")))


def ks_distance(counts: DataFrame, by: str = "feature") -> DataFrame:
    """Largest gap between two empirical distributions per ``by``.

    ``counts`` holds one row per (by, value) with ``n_ref`` and ``n_cur``. ``by`` must be a bounded set.
    Runs one job: the counts are written to the shared folder.
    """
    placed = bucketed_counts(cut_lineage(counts), by)
    whole = W.partitionBy(by)
    order = whole.orderBy("bucket")
    totals = placed.groupBy(by, "bucket").agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c"))
    totals = totals.select(
        by,
        "bucket",
        (F.sum("r").over(order) - F.col("r")).alias("ref_before"),
        (F.sum("c").over(order) - F.col("c")).alias("cur_before"),
        F.sum("r").over(whole).alias("ref_all"),
        F.sum("c").over(whole).alias("cur_all"),
    )
    inside = W.partitionBy(by, "bucket").orderBy("value")
    steps = placed.join(totals, [by, "bucket"]).select(
        by,
        "ref_all",
        "cur_all",
        (F.col("ref_before") + F.sum("n_ref").over(inside)).alias("ref_upto"),
        (F.col("cur_before") + F.sum("n_cur").over(inside)).alias("cur_upto"),
    )
    enough = (F.col("ref_all") >= 2) & (F.col("cur_all") >= 2)
    gap = F.abs(F.col("ref_upto") / F.col("ref_all") - F.col("cur_upto") / F.col("cur_all"))
    return steps.groupBy(by).agg(F.max(F.when(enough, gap)).alias("ks"))
