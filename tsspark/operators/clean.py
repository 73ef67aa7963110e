"""Cleaning: dates, values, duplicates, calendar gaps, outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.operators.long_series import BLOCK_ROWS, LongSeries
from tsspark.operators.ordered import exact_quantiles
from tsspark.operators.sketches import daily_sketches, sketch_quantiles
from tsspark.sources.files import require_columns


@dataclass(frozen=True)
class ClipRule:
    """Absolute bounds, or quartile bounds for those not given."""

    lower: float | None = None
    upper: float | None = None
    by_quartiles: bool = False
    multiplier: float = 1.5
    #: Quartiles from a sketch (one pass, bounded rank error) in place of exact ones.
    approximate: bool = False


def clean_dates(df: DataFrame, date: str = "date", timezone: str | None = None) -> DataFrame:
    """Date column as a plain day. A zoned timestamp is read in ``timezone`` first."""
    if date not in df.columns:
        return df
    moment = F.col(date)
    if timezone and dict(df.dtypes)[date] == "timestamp":
        moment = F.convert_timezone(F.current_timezone(), F.lit(timezone), moment.cast("timestamp_ntz"))
    return df.withColumn(date, moment.cast("date"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key by an explicit order.

    Spark cuts each map task's rows to one per key before the shuffle (a window group limit), so a key
    holding most of the table does not end up in one task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def clean_values(
    df: DataFrame,
    value: str = "target",
    drop_null: bool = True,
    lower: float | None = None,
    upper: float | None = None,
    unique_by: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Drop missing values, clip, then keep the first row per key."""
    if value not in df.columns:
        return df
    if drop_null:
        df = df.dropna(subset=[value])
    df = df.withColumn(value, _bounded(F.col(value), lower, upper))
    if unique_by and all(k in df.columns for k in unique_by):
        if not order:
            raise ValueError("Keeping the first row per key needs an explicit order.")
        df = keep_first(df, unique_by, order)
    return df


def clean(df: DataFrame, date: str = "date", timezone: str | None = None, **values) -> DataFrame:
    return clean_values(clean_dates(df, date, timezone), **values)


def _bounded(value: Column, lower: float | Column | None, upper: float | Column | None) -> Column:
    """NULL stays NULL; ``greatest`` and ``least`` alone would replace it by the bound."""
    bounded = value
    if lower is not None:
        bounded = F.greatest(bounded, lower if isinstance(lower, Column) else F.lit(float(lower)))
    if upper is not None:
        bounded = F.least(bounded, upper if isinstance(upper, Column) else F.lit(float(upper)))
    return bounded if bounded is value else F.when(value.isNotNull(), bounded)


def _spans(df: DataFrame, entity: str, date: str, target: str, span: str) -> DataFrame:
    """(entity, date, target) with the days that each row stands for: ``_first`` (its own, or earlier) to ``_upto``."""
    series = W.partitionBy(entity).orderBy(date)
    narrow = df.select(entity, date, target).dropna(subset=[entity, date])
    first, last = F.col(date), F.col(date)
    if span == "global":
        ends = narrow.agg(F.struct(F.min(date).alias("first"), F.max(date).alias("last"))).scalar()
        first = F.when(F.lag(date).over(series).isNull(), ends["first"]).otherwise(F.col(date))
        last = ends["last"]
    upto = F.greatest(F.coalesce(F.date_sub(F.lead(date).over(series), 1), last), F.col(date))
    return narrow.withColumns({"_first": first, "_upto": upto})


def filled_counts(df: DataFrame, strategy: str, entity: str, date: str, target: str, span: str) -> DataFrame:
    """(value, w): what ``fill_missing`` puts after ``reindex_daily`` and on how many days, without unfolding the days."""
    spans = _spans(df, entity, date, target, span)
    after, before = F.datediff("_upto", date), F.datediff(date, "_first")
    value = F.col(target).cast("double")
    if strategy == "zero":
        own = F.struct(F.coalesce(value, F.lit(0.0)).alias("value"), F.lit(1).alias("w"))
        added = F.struct(F.lit(0.0).alias("value"), (before + after).alias("w"))
        return spans.select(F.inline(F.array(own, added))).where(F.col("w") > 0)
    past = W.partitionBy(entity).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return spans.select(F.last(value, ignorenulls=True).over(past).alias("value"), (after + 1).alias("w"))


def reindex_daily(
    df: DataFrame, entity: str | None = "entity", date: str = "date", target: str = "target", span: str = "per_entity", block_rows: int = BLOCK_ROWS,
    strategy: str | None = None, filled: str = "target_cleaned",
) -> DataFrame:
    """Every day between the first and last date of each entity (or of the whole panel).

    Only entity, date and target survive; the target of an added day is NULL. Each row looks up the next
    date of its series and unfolds the days up to it, so the calendar is neither joined nor shuffled: one
    exchange on the entity, which a later window over the series reuses. Needs unique (entity, date).
    Without an entity the table is one series, unfolded block by block (``long_series``, which runs jobs).
    With a ``strategy`` the result also has ``filled``, as ``fill_missing`` makes it: the given rows are filled, and each
    day of a gap takes what its row carries, so the unfolded days are never sorted.
    """
    if strategy and entity is None:
        return fill_missing(reindex_daily(df, None, date, target, span, block_rows), strategy, None, date, target, filled, block_rows=block_rows)
    if entity is None:
        return LongSeries.of(df.select(date, target), date, block_rows).unfold(target).frame()
    placed = _spans(df, entity, date, target, span)
    carried = [filled] if strategy else []
    if strategy:
        placed = fill_missing(placed, strategy, entity, date, target, filled)
    days = F.sequence("_first", "_upto", F.make_dt_interval(F.lit(1)))
    unfolded = placed.select(entity, F.col(date).alias("_own"), F.col(target).alias("_value"), *carried, F.explode(days).alias(date))
    own = F.col(date) == F.col("_own")
    added = F.lit(0.0) if strategy == "zero" else F.when(F.col(date) > F.col("_own"), F.col(filled))
    return unfolded.select(
        entity, date, F.when(own, F.col("_value")).alias(target), *[F.when(own, F.col(c)).otherwise(added).alias(c) for c in carried]
    )


def fill_missing(
    df: DataFrame,
    strategy: str = "forward_fill",
    entity: str | None = "entity",
    date: str = "date",
    target: str = "target",
    filled: str = "target_cleaned",
    ties: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Carry the last value forward (a leading gap stays NULL), or put zero.

    Without an entity the table is one series in the order of date and ``ties``, carried block by block
    (``long_series``, which runs jobs).
    """
    if strategy == "forward_fill" and entity is None:
        return LongSeries.of(df, (date, *ties), block_rows).carry_forward(target, filled).frame()
    if strategy == "forward_fill":
        past = W.partitionBy(entity).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(filled, F.last(F.col(target).cast("double"), ignorenulls=True).over(past))
    if strategy == "zero":
        return df.withColumn(filled, F.coalesce(F.col(target).cast("double"), F.lit(0.0)))
    raise ValueError(f"Unknown fill strategy: {strategy}")


def clip_outliers(
    df: DataFrame, rule: ClipRule, column: str = "target_cleaned", sketches: DataFrame | None = None, weighted: DataFrame | None = None
) -> DataFrame:
    """Clip to absolute bounds, or to quartile fences over the whole column; given bounds win.

    Exact quartiles run a job while the plan is built. Approximate ones don't; with ``sketches``, a table of day sketches
    (see ``sketches``), ``df`` isn't read for them at all, so fences of a growing panel cost its new days only.
    ``weighted`` gives the same values as rows (value, w), for exact quartiles without ``df``.
    """
    lower, upper = rule.lower, rule.upper
    if rule.by_quartiles:
        if rule.approximate or sketches is not None:
            found = sketch_quantiles(daily_sketches(df, column, None) if sketches is None else sketches, (0.25, 0.75))
        elif weighted is not None:
            found = exact_quantiles(weighted, "value", (0.25, 0.75), weight="w")
        else:
            found = exact_quantiles(df, column, (0.25, 0.75))
        quartiles = found.scalar()
        reach = F.lit(rule.multiplier) * (quartiles[1] - quartiles[0])
        lower = quartiles[0] - reach if lower is None else lower
        upper = quartiles[1] + reach if upper is None else upper
    return df.withColumn(column, _bounded(F.col(column), lower, upper))


def clean_retail(
    df: DataFrame,
    entity: str = "entity",
    date: str = "date",
    target: str = "target",
    filled: str = "target_cleaned",
    reindex: bool = True,
    span: str = "per_entity",
    strategy: str = "forward_fill",
    clip: ClipRule | None = None,
) -> DataFrame:
    """Gap fill and clip beside the raw target. Without reindexing all other columns are kept."""
    require_columns(df, (date, entity, target), "clean_retail input")
    days = clean_dates(df, date)
    weighted = None
    if reindex and clip and clip.by_quartiles and not clip.approximate:
        weighted = filled_counts(days, strategy, entity, date, target, span)
    if reindex:
        out = reindex_daily(days, entity, date, target, span, strategy=strategy, filled=filled)
    else:
        out = days.withColumn(filled, F.col(target).cast("double"))
    return clip_outliers(out, clip, filled, weighted=weighted) if clip else out
