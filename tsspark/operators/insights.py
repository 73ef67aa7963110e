"""Rule-based description of forecast series: trend, volatility, step changes, confidence, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.functions import texts
from tsspark.functions.rounding import round_stored
from tsspark.functions.missing import is_finite

# Metrics that the text names, in this order.
METRIC_NAMES = ("mae", "rmse", "mape", "mae_val", "rmse_val")

# Thresholds of the rules.
MARGIN = 1e-9
NOISE = 1e-12
SLOPE_STRONG, SLOPE_WEAK = 0.12, 0.04
LEVEL_CV, LEVEL_SLOPE = 0.02, 0.18
CV_HIGH = 0.22
ANOMALY_Z, MAD_SCALE = 2.5, 1.4826


def step_changes(series: DataFrame, entity: str = "entity_id", step: str = "step", value: str = "y_pred") -> DataFrame:
    """Points of each series with position ``i``, value ``y``, difference ``d`` and ``anomaly``.

    Positions count finite values; other rows come last, with ``y`` NULL. A difference is an anomaly if it
    is far from the median difference, in units of the median absolute deviation. Series are forecasts,
    so a group has no more rows than the horizon; one shuffle.
    """
    whole = W.partitionBy(entity)
    good = is_finite(F.col(value))
    y = F.when(good, F.col(value).cast("double"))
    order = whole.orderBy(F.when(good, 0).otherwise(1), step)
    points = series.select(
        entity, y.alias("y"), (F.row_number().over(order) - 1).alias("i"),
        (y - F.lag(y).over(order)).alias("d"), F.count(y).over(whole).alias("n"),
    )
    centred = points.withColumn("m", F.percentile("d", F.lit(0.5)).over(whole))
    spread = centred.withColumn("mad", F.percentile(F.abs(F.col("d") - F.col("m")), F.lit(0.5)).over(whole) + MARGIN)
    z = F.abs(F.col("d") - F.col("m")) / (MAD_SCALE * F.col("mad"))
    flag = F.coalesce((F.col("n") >= 3) & (z > ANOMALY_Z), F.lit(False))
    return spread.select(entity, "i", "y", "d", flag.alias("anomaly"))


def normalised_slope(y: Column, i: Column) -> Column:
    """Least-squares slope over the position, in units of the sample deviation; 0 below two points.

    What floating point leaves of a slope of zero is zero, so that its sign says nothing.
    """
    slope = F.regr_slope(y, i.cast("double")) / (F.stddev_samp(y) + MARGIN)
    return F.when((F.count(y) >= 2) & (F.abs(slope) >= NOISE), slope).otherwise(0.0)


def coefficient_of_variation(y: Column) -> Column:
    return F.coalesce(F.stddev_samp(y), F.lit(0.0)) / (F.avg(F.abs(y)) + MARGIN)


def series_measures(
    series: DataFrame, entity: str = "entity_id", step: str = "step", value: str = "y_pred"
) -> DataFrame:
    """Number of points, slope, variation and change points per series, also for one without points."""
    changed = F.sort_array(F.collect_list(F.when(F.col("anomaly"), F.col("i"))))
    y = F.col("y")
    return step_changes(series, entity, step, value).groupBy(entity).agg(
        F.count(y).alias("n_points"),
        normalised_slope(y, F.col("i")).alias("slope"),
        F.when(F.count(y) >= 2, coefficient_of_variation(y)).otherwise(0.0).alias("cv"),
        changed.alias("changes"),
    )


def _shape() -> Column:
    """Which trend rule applies; the two flat rules are told apart for the text."""
    slope, cv = F.col("slope"), F.col("cv")
    return (
        F.when(F.col("n_points") < 2, F.lit("insufficient"))
        .when((cv < LEVEL_CV) & (F.abs(slope) < LEVEL_SLOPE), F.lit("stable_level"))
        .when(slope > SLOPE_STRONG, F.lit("upward"))
        .when(slope < -SLOPE_STRONG, F.lit("downward"))
        .when(F.abs(slope) < SLOPE_WEAK, F.lit("stable"))
        .when(slope > 0, F.lit("moderate_up"))
        .otherwise(F.lit("moderate_down"))
    )


def _confidence() -> Column:
    n, cv = F.col("n_points"), F.col("cv")
    n_changes = F.size("changes")
    coverage = F.least(F.lit(1.0), n / 24.0)
    strength = F.least(F.lit(1.0), F.abs("slope") / 0.25)
    volatility = F.when(cv > 0.08, F.least(F.lit(1.0), cv / 0.35)).otherwise(0.35)
    jumps = F.least(F.lit(1.0), 0.4 + 0.15 * F.least(n_changes, F.lit(4)))
    raw = 0.35 * coverage + 0.35 * strength + 0.15 * volatility + 0.15 * jumps
    return F.when(n < 2, 0.2).otherwise(round_stored(F.least(F.lit(0.92), F.greatest(F.lit(0.18), raw)), 3))


def describe_series(
    series: DataFrame, entity: str = "entity_id", step: str = "step", value: str = "y_pred"
) -> DataFrame:
    """Trend label, rounded slope and variation, volatility, and all change points per series."""
    m = series_measures(series, entity, step, value)
    shape = _shape()
    trend = F.when(shape.isin("stable_level", "stable"), F.lit("flat")).otherwise(shape)
    volatility = (
        F.when(F.col("n_points") < 2, F.lit("unknown"))
        .when(F.col("cv") >= CV_HIGH, F.lit("high"))
        .otherwise(F.lit("low_or_moderate"))
    )
    return m.select(
        entity,
        "n_points",
        trend.alias("trend"),
        round_stored(F.col("slope"), 4).alias("slope_normalized"),
        round_stored(F.col("cv"), 4).alias("coefficient_of_variation"),
        volatility.alias("volatility"),
        F.size("changes").alias("n_change_points"),
        F.col("changes").alias("change_point_indices"),
    )


def insight_confidence(series: DataFrame, entity: str = "entity_id", step: str = "step", value: str = "y_pred") -> DataFrame:
    """Confidence of the description, from length, slope, variation and change points."""
    return series_measures(series, entity, step, value).select(entity, "n_points", _confidence().alias("confidence"))


def _metrics_text(metrics: DataFrame | None) -> Column:
    if metrics is None:
        return F.lit(texts.NO_METRICS)
    named = [c for c in METRIC_NAMES if c in metrics.columns]
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), texts.general(F.col(c)))) for c in named]))
    return (
        F.when(F.col("has_metrics").isNull(), F.lit(texts.NO_METRICS))
        .when(F.size(parts) == 0, F.lit(texts.NO_KNOWN_METRICS))
        .otherwise(F.concat(F.array_join(parts, "; "), F.lit(".")))
    )


def insight_text(
    series: DataFrame,
    metrics: DataFrame | None = None,
    entity: str = "entity_id",
    step: str = "step",
    value: str = "y_pred",
) -> DataFrame:
    """(entity, summary, insights, confidence); ``metrics`` is one optional row per entity."""
    m = series_measures(series, entity, step, value).withColumn("shape", _shape())
    if metrics is not None:
        kept = [c for c in METRIC_NAMES if c in metrics.columns]
        m = m.join(metrics.select(entity, *kept, F.lit(True).alias("has_metrics")), entity, "left")
    slope, cv = texts.fixed(F.col("slope"), 3), F.col("cv")

    def by_shape(lines: dict[str, Column]) -> Column:
        chosen = F.lit(None).cast("string")
        for name, line in lines.items():
            chosen = F.when(F.col("shape") == name, line).otherwise(chosen)
        return chosen

    lines = {k: F.format_string(t, slope) for k, t in texts.TREND_LINES.items() if k != "stable_level"}
    lines["stable_level"] = F.format_string(texts.TREND_LINES["stable_level"], texts.fixed(cv, 4), slope)
    parts = {k: F.lit(t) for k, t in texts.TREND_PARTS.items()}
    parts["stable_level"] = parts["stable"]

    n_changes = F.size("changes")
    volatile = cv >= CV_HIGH
    more = F.when(n_changes > 5, F.format_string(" (+%d more)", n_changes - 5)).otherwise(F.lit(""))
    first = F.array_join(F.slice("changes", 1, 5).cast("array<string>"), ", ")
    insights = F.concat_ws(
        "\n",
        by_shape(lines),
        F.when(volatile, F.format_string(texts.VOLATILE_LINE, texts.fixed(cv, 3))).otherwise(
            F.format_string(texts.CALM_LINE, texts.fixed(cv, 3))
        ),
        F.when(n_changes > 0, F.format_string(texts.STEPS_LINE, n_changes.cast("string"), first, more)).otherwise(
            F.lit(texts.NO_STEPS_LINE)
        ),
        F.concat(F.lit(texts.CONTEXT_LINE), _metrics_text(metrics)),
    )
    shown = F.array_compact(
        F.array(by_shape(parts), F.when(volatile, F.lit(texts.VOLATILE_PART)), F.when(n_changes > 0, F.lit(texts.STEPS_PART)))
    )
    listed = F.concat(
        F.array_join(F.slice(shown, 1, 2), ", "),
        F.when(F.size(shown) > 2, F.concat(F.lit(", with "), F.get(shown, 2))).otherwise(F.lit("")),
    )
    summary = F.format_string(texts.SUMMARY, F.col("n_points").cast("string"), listed)
    short = F.col("n_points") < 2
    short_insights = F.concat(F.lit(texts.NOT_ENOUGH_LINE + "\n" + texts.CONTEXT_LINE), _metrics_text(metrics))
    return m.select(
        entity,
        F.when(short, F.lit(texts.NOT_ENOUGH_SUMMARY)).otherwise(summary).alias("summary"),
        F.when(short, short_insights).otherwise(insights).alias("insights"),
        F.when(short, 0.15).otherwise(_confidence()).alias("confidence"),
    )


def mape_band(mape: Column) -> Column:
    """Band of a MAPE; values up to 1 are read as fractions."""
    share = mape_percent(mape)
    return F.when(share >= 20, F.lit("high")).when(share >= 15, F.lit("elevated")).when(share.isNotNull(), F.lit("reasonable"))


def mape_percent(mape: Column) -> Column:
    return F.when(mape <= 1.0, mape * 100.0).otherwise(mape)


def drift_band(score: Column, threshold: Column) -> Column:
    limit = drift_limit(threshold)
    return F.when(score < limit * 0.5, F.lit("none")).when(score < limit, F.lit("below")).when(score.isNotNull(), F.lit("elevated"))


def drift_limit(threshold: Column) -> Column:
    return F.when(threshold > 0, threshold).otherwise(F.lit(0.25))


def metric_bands(rows: DataFrame) -> DataFrame:
    """Rows with mape, overall_score and threshold, plus their bands."""
    return rows.withColumns(
        {"mape_band": mape_band(F.col("mape")), "drift_band": drift_band(F.col("overall_score"), F.col("threshold"))}
    )


def intent_tags(text: Column) -> Column:
    """Intents whose keywords occur anywhere in the lower-cased text, in a fixed order.

    Plain substring tests; the text is lower-cased once and handed to them as a lambda variable.
    """

    def tags(question: Column) -> Column:
        found = []
        for name, words in texts.INTENT_WORDS.items():
            hit = question.contains(words[0])
            for word in words[1:]:
                hit = hit | question.contains(word)
            found.append(F.when(hit, F.lit(name)))
        return F.array_compact(F.array(*found))

    found = F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), tags), 0)
    return F.when(F.size(found) == 0, F.array(F.lit(texts.GENERAL_INTENT))).otherwise(found)


def insight_context(
    latest: DataFrame, evaluations: DataFrame, monitoring: DataFrame, entity: str = "entity"
) -> DataFrame:
    """Per entity: latest forecast, its evaluation, and the monitoring row; ``source`` names the winner.

    Metrics come from the evaluation where it succeeded, else from monitoring.
    """
    meta = latest.groupBy(F.col("entity_id").alias(entity)).agg(
        F.count(F.lit(1)).alias("n_points"), F.max("recorded_at").alias("recorded_at"), F.max("step").alias("horizon")
    )
    scored = evaluations.select(
        entity, F.col("status").alias("eval_status"), F.col("reason").alias("eval_reason"), F.col("message").alias("eval_message"),
        *[F.col(c).alias(f"eval_{c}") for c in ("mae", "rmse", "mape", "n_samples")],
    )
    joined = monitoring.join(meta, entity, "left").join(scored, entity, "left")
    won = F.coalesce((F.col("eval_status") == "ok") & F.col("n_points").isNotNull(), F.lit(False))

    def pick(name: str, other: str) -> Column:
        return F.when(won, F.col(f"eval_{name}")).otherwise(F.col(other))

    return joined.select(
        entity,
        "n_points",
        "horizon",
        "recorded_at",
        "eval_status",
        "eval_reason",
        "eval_message",
        pick("mae", "mae").alias("mae"),
        pick("rmse", "rmse").alias("rmse"),
        pick("mape", "mape").alias("mape"),
        pick("n_samples", "evaluated_points").alias("sample_size"),
        F.when(won, F.lit("last_forecast_vs_actuals")).otherwise(F.coalesce("source", F.lit("monitoring_or_unavailable"))).alias("source"),
        F.col("mae").alias("monitored_mae"),
        F.col("mape").alias("monitored_mape"),
        "drift_detected",
        "overall_score",
        "threshold",
        "alert_mae",
        "alert_mape",
        "alert_drift",
        "overall_status",
    )


def recent_points(
    forecasts: DataFrame, limit: int | None = None, entity: str = "entity_id", order: str = "date", value: str = "y_pred"
) -> DataFrame:
    """The points per series as an array, with the total and, under a ``limit``, whether older ones were left out.

    The total is a separate combinable count; only ``limit`` rows per series are collected, and
    map tasks cut to that before the shuffle.
    """
    totals = forecasts.groupBy(entity).agg(F.count(F.lit(1)).alias("n_points_total"))
    back = F.row_number().over(W.partitionBy(entity).orderBy(F.col(order).desc()))
    tail = forecasts.select(entity, order, value)
    if limit is not None:
        tail = tail.withColumn("_back", back).where(F.col("_back") <= limit)
    kept = tail.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("points"))
    return kept.join(totals, entity).select(
        entity,
        "points",
        "n_points_total",
        F.size("points").alias("n_points_included"),
        (F.col("n_points_total") > F.size("points")).alias("truncated"),
    )
