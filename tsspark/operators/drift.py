"""Distribution drift between an early and a late part of a panel.

Numeric columns are unpivoted to (half, feature, value), so each measure is one grouped aggregate
whatever the number of features. A feature without a single value scores 0 and is counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.config import MonitorConfig
from tsspark.functions.missing import is_finite, is_numeric
from tsspark.operators.ordered import date_counts, edges_passed, half_split, ks_distance

# Columns looked at first, sample sizes, smoothing terms, status bounds.
PREFERRED = ("target_cleaned", "Sales", "Customers", "Open", "Promo", "SchoolHoliday")
MIN_ROWS = 50
MIN_HALF = 20
EDGE_MARGIN = 1e-10
SHARE_MARGIN = 1e-10
SPREAD_MARGIN = 1e-9
LOW_BELOW, MEDIUM_BELOW = 1.0 / 3.0, 2.0 / 3.0


def numeric_columns(
    schema: T.StructType, target: str | None = None, skip: Sequence[str] = ("entity", "date", "store_id", "Date", "Store")
) -> list[str]:
    """Preferred columns, the target in front, else all numeric ones."""
    numeric = [f.name for f in schema.fields if is_numeric(f.dataType)]
    chosen = [c for c in PREFERRED if c in numeric]
    if target in numeric and target not in chosen:
        chosen.insert(0, target)
    return chosen or [c for c in numeric if c not in skip]


def long_form(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ("half",)) -> DataFrame:
    """(ids, feature, value) without missing values."""
    narrow = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    return narrow.unpivot(list(ids), list(features), "feature", "value").where(F.col("value").isNotNull())


def bin_edges(n: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width edges; the last one a little higher so that the maximum is inside."""
    step = (high - low) / bins
    inner = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: low + i * step)
    return (
        F.when(n == 0, F.array(F.lit(0.0), F.lit(1.0)))
        .when(n == 1, F.array(low, low + EDGE_MARGIN))
        .otherwise(F.concat(inner, F.array(high + EDGE_MARGIN)))
    )


def fit_edges(long: DataFrame, bins: int = 10, within: Column | None = None) -> DataFrame:
    """Edges per feature from the reference values."""
    value = F.col("value") if within is None else F.when(within, F.col("value"))
    stats = long.groupBy("feature").agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return stats.select("feature", bin_edges(F.col("n"), F.col("low"), F.col("high"), bins).alias("edges"))


def histogram(long: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin (from 1). Bins are closed on the left, the last one on both sides; values outside
    the edges are not counted."""
    placed = long.join(edges, "feature")
    inside = (F.col("value") >= F.col("edges")[0]) & (F.col("value") <= F.element_at("edges", -1))
    bin_id = F.least(edges_passed(F.col("value"), F.col("edges")), F.size("edges") - 1)
    return placed.where(inside).groupBy(*by, "feature", bin_id.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drift_scores(long: DataFrame, bins: int = 10) -> DataFrame:
    """Per feature, the summed absolute differences of bin shares between the halves (0 to 2)."""
    is_ref = F.col("half") == "reference"
    counts = histogram(long, fit_edges(long, bins, within=is_ref), by=("half",))
    per_bin = counts.groupBy("feature", "bin").agg(
        F.sum(F.when(is_ref, F.col("n")).otherwise(0)).alias("ref"),
        F.sum(F.when(is_ref, 0).otherwise(F.col("n"))).alias("cur"),
    )
    whole = W.partitionBy("feature")  # at most `bins` rows

    def share(c: str) -> Column:
        return F.col(c) / (F.sum(c).over(whole) + SHARE_MARGIN)

    gaps = per_bin.select("feature", F.abs(share("cur") - share("ref")).alias("gap"))
    return gaps.groupBy("feature").agg(F.sum("gap").alias("score"))


def every_feature(scores: DataFrame, features: Sequence[str], score: str) -> DataFrame:
    """A row for each of the features; those that had no value score 0."""
    names = scores.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(scores, "feature", "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def feature_drift(
    df: DataFrame, config: MonitorConfig = MonitorConfig(), entity: str = "entity", date: str = "date", min_rows: int = MIN_ROWS
) -> DataFrame:
    """One row: overall score, flag, sizes, and scores by feature; all NULL with a note if not run."""
    features = numeric_columns(df.schema, skip=(entity, date))
    counts = date_counts(df, date, entity)
    sizes = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    note = F.when(F.lit(not config.drift_enabled), F.lit("drift checks disabled in config")).when(
        F.col("rows") < min_rows, F.lit("insufficient rows for drift")
    )
    if not features:
        note = F.coalesce(note, F.lit("no numeric columns for drift"))
    if not features or not config.drift_enabled:
        scored = F.lit(None).cast("struct<overall_score:double,per_feature_scores:map<string,double>>")
    else:
        scores = every_feature(drift_scores(long_form(half_split(df, date, entity, counts=counts), features), config.drift_bins), features, "score")
        scored = scores.agg(
            F.struct(
                F.avg("score").alias("overall_score"),
                F.map_from_entries(F.collect_list(F.struct("feature", "score"))).alias("per_feature_scores"),
            )
        ).scalar()
    counted = sizes.select("rows", note.alias("note"), scored.alias("s"))
    ran = F.col("note").isNull()
    overall = F.when(ran, F.coalesce(F.col("s.overall_score"), F.lit(0.0)))
    no_scores = F.lit(None).cast("map<string,double>")
    return counted.select(
        (overall > config.drift_threshold).alias("drift_detected"),
        overall.alias("overall_score"),
        F.lit(config.drift_threshold).alias("threshold"),
        F.when(ran, F.col("s.per_feature_scores")).otherwise(no_scores).alias("per_feature_scores"),
        F.when(ran, F.floor(F.col("rows") / 2)).when(F.col("rows") < min_rows, F.col("rows")).otherwise(0).alias("ref_sample_size"),
        F.when(ran, F.col("rows") - F.floor(F.col("rows") / 2)).otherwise(0).alias("current_sample_size"),
        "note",
    )


def _moments(long: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Count, mean and sample deviation of both halves."""
    is_ref = F.col("half") == "reference"
    ref, cur = F.when(is_ref, F.col("value")), F.when(~is_ref, F.col("value"))
    return long.groupBy(*keys).agg(
        F.count(ref).alias("n_ref"), F.count(cur).alias("n_cur"),
        F.avg(ref).alias("m_ref"), F.avg(cur).alias("m_cur"),
        F.stddev_samp(ref).alias("s_ref"), F.stddev_samp(cur).alias("s_cur"),
        *more,
    )


def _enough() -> Column:
    return (F.col("n_ref") >= 2) & (F.col("n_cur") >= 2)


def _mean_std() -> Column:
    mean_move = F.abs(F.col("m_cur") - F.col("m_ref")) / (F.abs("m_ref") + SPREAD_MARGIN)
    std_move = F.abs(F.col("s_cur") - F.col("s_ref")) / (F.col("s_ref") + SPREAD_MARGIN)
    score = (F.least(mean_move, F.lit(1.0)) + F.least(std_move, F.lit(1.0))) / 2
    return F.when(_enough(), score).otherwise(0.0)


def mean_std_drift(long: DataFrame) -> DataFrame:
    """Relative change of mean and of sample deviation, each capped at 1, averaged."""
    finite = long.where(is_finite(F.col("value")))
    return _moments(finite, ["feature"]).select("feature", _mean_std().alias("mean_std"))


def ks_statistic(long: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature, NULL below two values a side."""
    is_ref = F.col("half") == "reference"
    counts = (
        long.where(is_finite(F.col("value")))
        .groupBy("feature", "value")
        .agg(F.count_if(is_ref).alias("n_ref"), F.count_if(~is_ref).alias("n_cur"))
    )
    return ks_distance(counts)


def _summarise(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    mixed = parts.groupBy(*by).agg(
        F.avg("mean_std").alias("ms"), F.avg("ks").alias("ks"), F.count(F.lit(1)).alias("n_features")
    )
    score = F.when(F.col("ks").isNull(), F.col("ms")).otherwise(0.5 * F.col("ms") + 0.5 * F.col("ks"))
    clamped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    status = F.when(clamped < LOW_BELOW, F.lit("low")).when(clamped < MEDIUM_BELOW, F.lit("medium")).otherwise(F.lit("high"))
    return mixed.select(
        *by, clamped.alias("drift_score"), status.alias("status"), F.col("ks").isNotNull().alias("ks_used"), "n_features"
    )


def distribution_drift(
    df: DataFrame, target: str = "target", entity: str = "entity", date: str = "date", report_short: bool = False
) -> DataFrame:
    """One row (drift_score, status, ks_used, n_features).

    Below 20 rows a half there is none, or with ``report_short`` one without a score, its status ``not_enough_rows``.
    """
    features = numeric_columns(df.schema, target, skip=(entity, date))
    counts = date_counts(df, date, entity)
    long = long_form(half_split(df, date, entity, counts=counts), features)
    n = counts.agg(F.sum("rows")).scalar()
    moved = every_feature(mean_std_drift(long), features, "mean_std") if features else mean_std_drift(long)
    parts = moved.join(ks_statistic(long), "feature", "left").where(F.floor(n / 2) >= MIN_HALF)
    found = _summarise(parts, ()).where(F.col("n_features") > 0)
    if not report_short:
        return found
    few = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).where(F.floor(F.col("n") / 2) < MIN_HALF)
    short = few.select(
        F.lit(None).cast("double").alias("drift_score"), F.lit("not_enough_rows").alias("status"), F.lit(False).alias("ks_used"), F.lit(len(features)).alias("n_features")
    )
    return found.unionByName(short)


def distribution_drift_by_entity(
    df: DataFrame, target: str = "target", entity: str = "entity", date: str = "date", min_half: int = MIN_HALF
) -> DataFrame:
    """The same verdict for every entity at once, on halves of its own series.

    An entity with fewer than ``min_half`` rows a half has the status ``not_enough_rows`` and no score.
    """
    features = numeric_columns(df.schema, target, skip=(entity, date))
    series = W.partitionBy(entity)
    rank = F.row_number().over(series.orderBy(date))
    n = F.count(F.lit(1)).over(series)
    halves = df.withColumns({"_rank": rank, "_n": n})
    early = F.col("_rank") <= F.floor(F.col("_n") / 2)
    halves = halves.withColumn("half", F.when(early, F.lit("reference")).otherwise(F.lit("current")))
    halves = halves.withColumn("_enough", F.floor(F.col("_n") / 2) >= min_half)
    # missing values stay in, so that every entity and feature keeps a row; a group is one series of days,
    # so the steps of both distributions come from a plain window
    narrow = halves.select(entity, "half", "_enough", *[F.col(c).cast("double").alias(c) for c in features])
    usable = F.col("_enough") & is_finite(F.col("value"))
    long = narrow.unpivot([entity, "half", "_enough"], list(features), "feature", "value").withColumn("value", F.when(usable, F.col("value")))
    is_ref = (F.col("half") == "reference") & F.col("value").isNotNull()
    is_cur = (F.col("half") == "current") & F.col("value").isNotNull()
    whole = W.partitionBy(entity, "feature")
    upto = whole.orderBy("value")  # rows of equal value count together

    def share(c: Column) -> Column:
        return F.count_if(c).over(upto) / F.nullif(F.count_if(c).over(whole), F.lit(0))

    stepped = long.withColumn("gap", F.abs(share(is_ref) - share(is_cur)))
    parts = _moments(stepped, [entity, "feature"], F.max("gap").alias("gap"), F.max("_enough").alias("enough")).select(
        entity, "feature", "enough", _mean_std().alias("mean_std"), F.when(_enough(), F.col("gap")).alias("ks")
    )
    found = _summarise(parts, (entity, "enough"))
    shown = F.when(F.col("enough"), F.col("drift_score"))
    status = F.when(F.col("enough"), F.col("status")).otherwise(F.lit("not_enough_rows"))
    return found.select(entity, shown.alias("drift_score"), status.alias("status"), "ks_used", "n_features")


def drift_indicators(scores: DataFrame, threshold: float = 0.25) -> DataFrame:
    return scores.where(F.col("score") > threshold)
