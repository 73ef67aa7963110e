"""Approximate quantiles that are kept up to date: one mergeable sketch per day.

A day's values become one row: their number, their ends, and a KLL sketch as a binary column. Quantiles of any span of
days come from merging the sketches of those days, never from the values again, so a panel that grows by a day costs that
day. A sketch of up to ``k`` values holds all of them; beyond that the rank of what it returns is off by at most
``rank_error(k)`` of the number of values, with 99 % confidence, whatever that number and however it was merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 2048


def rank_error(k: int = SKETCH_K) -> float:
    """Bound on the difference between the wanted share and the rank of the value returned (fixed values: published fit)."""
    return 2.296 / k**0.9723


def daily_sketches(df: DataFrame, value: str, date: str | None = "date", k: int = SKETCH_K) -> DataFrame:
    """(date, n, least, greatest, sketch) of the values that are not missing; one row without a date column.

    Map tasks sketch their own rows, so what moves is a sketch per day and task.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("_value", F.col(value).cast("double"))
    days = known.groupBy(*([F.col(date).alias("date")] if date else []))
    return days.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_value").alias("least"),
        F.max("_value").alias("greatest"),
        F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` (all rows without it); rows without a value have no sketch and are skipped."""
    return sketches.where(F.col("n") > 0).groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def append_days(sketches: DataFrame, new: DataFrame) -> DataFrame:
    """A table of day sketches with those of new rows added: new days are new rows, days already there are merged."""
    return merged_sketches(sketches.unionByName(new), ["date"])


def replace_days(sketches: DataFrame, new: DataFrame) -> DataFrame:
    """The same where ``new`` holds whole days: what was there for them goes."""
    return sketches.join(new.select("date"), "date", "left_anti").select(*sketches.columns).unionByName(new)


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``quantiles array<double>`` of all days together, or per ``by``; entries are NULL where there is no value.

    The ends of the values are exact.
    """
    merged = merged_sketches(sketches, by)

    def at(share: float) -> Column:
        if share in (0, 1):
            return F.col("greatest" if share else "least")
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))))

    return merged.select(*by, F.array(*[at(s) for s in shares]).alias("quantiles"))
