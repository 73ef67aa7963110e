"""Answers to questions about an entity, composed from its forecast description and monitoring row.

What can be said about an entity is worded once per entity; every question then meets its entity's row in one join and
chooses. All wording is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.functions import texts
from tsspark.functions.rounding import round_stored
from tsspark.operators.insights import drift_band, drift_limit, intent_tags, mape_band, mape_percent


def _choose(key: Column, options: dict[str, Column]) -> Column:
    chosen = F.lit(None).cast("string")
    for name, text in options.items():
        chosen = F.when(key == name, text).otherwise(chosen)
    return chosen


def _sentences(key: Column, options: dict[str, str]) -> Column:
    return _choose(key, {k: F.lit(t) for k, t in options.items()})


def _reasons(key: Column, options: dict[str, str], *numbers: Column) -> Column:
    return _choose(key, {k: F.format_string(t, *numbers) for k, t in options.items()})


def _line(title: str, text: Column) -> Column:
    return F.concat(F.lit(f"- **{title}**: "), text)


def _worded(context: DataFrame, entity: str) -> DataFrame:
    """``context`` with everything there is to say about an entity, worded once, whatever the number of questions."""
    c = F.col
    if "eval_message" not in context.columns:
        context = context.withColumn("eval_message", F.lit(None).cast("string"))
    described = c("n_points").isNotNull()
    direction = (
        F.when(c("trend").isin("upward", "moderate_up"), F.lit("up"))
        .when(c("trend").isin("downward", "moderate_down"), F.lit("down"))
        .when(c("trend") != "insufficient", F.lit("flat"))
    )
    slope, variation = texts.plain(c("slope_normalized")), texts.plain(c("coefficient_of_variation"))
    trend_says = _sentences(direction, texts.TREND_SENTENCES)
    trend_why = F.when(direction.isNull(), F.lit(texts.TREND_TOO_SHORT)).otherwise(
        _reasons(direction, texts.TREND_REASONS, slope, c("n_points").cast("string"))
    )
    swing_says = _sentences(c("volatility"), texts.VOLATILITY_SENTENCES)
    swing_why = _reasons(c("volatility"), texts.VOLATILITY_REASONS, variation)
    jumps = c("n_change_points")
    first = F.array_join(F.slice("change_point_indices", 1, 5).cast("array<string>"), ", ")
    rest = F.when(jumps > 5, F.format_string(" (+%d more)", jumps - 5)).otherwise(F.lit(""))
    steps_says = F.when(jumps > 0, F.format_string(texts.STEPS_SENTENCE, jumps.cast("string"))).otherwise(F.lit(texts.NO_STEPS_SENTENCE))
    steps_why = F.when(jumps > 0, F.format_string(texts.STEPS_REASON, first, rest)).otherwise(F.lit(texts.NO_STEPS_REASON))

    band = mape_band(c("mape"))
    error_says = _sentences(band, texts.MAPE_SENTENCES)
    error_why = _reasons(band, texts.MAPE_REASONS, texts.fixed(mape_percent(c("mape")), 1))
    moved = drift_band(c("overall_score"), c("threshold"))
    drift_says = _sentences(moved, texts.DRIFT_SENTENCES)
    drift_why = _reasons(moved, texts.DRIFT_REASONS, texts.fixed(c("overall_score"), 3), texts.fixed(drift_limit(c("threshold")), 3))

    raised = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(c(flag), F.lit(False)),
                    F.concat(F.lit(f"**{label}** (value `"), c(value).cast("string"), F.lit("` vs threshold `"), c(limit).cast("string"), F.lit("`)")),
                )
                for label, flag, value, limit in (
                    ("MAE", "alert_mae", "monitored_mae", "mae_alert"),
                    ("MAPE", "alert_mape", "monitored_mape", "mape_alert"),
                    ("Drift", "alert_drift", "overall_score", "drift_alert"),
                )
            ]
        )
    )
    record = F.when(
        described & c("recorded_at").isNotNull(),
        F.concat(
            F.lit("- **Latest forecast (API)**: store `"), c(entity).cast("string"), F.lit("`, horizon `"), c("horizon").cast("string"),
            F.lit("`, `"), c("n_points").cast("string"), F.lit("` points, recorded `"), c("recorded_at").cast("string"), F.lit("`."),
        ),
    )
    unscored = F.when(
        (c("eval_status") != "ok") & (c("eval_reason") != "no_forecast_record"),
        F.concat(
            F.lit("- **Forecast vs actuals**: `"), c("eval_reason"), F.lit("`"),
            F.coalesce(F.concat(F.lit(" — "), F.substring("eval_message", 1, texts.QUOTED_MESSAGE)), F.lit("")),
        ),
    )
    return context.select(
        "*",
        trend_says.alias("_trend_says"), trend_why.alias("_trend_why"), swing_says.alias("_swing_says"), swing_why.alias("_swing_why"),
        steps_says.alias("_steps_says"), steps_why.alias("_steps_why"), error_says.alias("_error_says"), error_why.alias("_error_why"),
        drift_says.alias("_drift_says"), drift_why.alias("_drift_why"), F.array_join(raised, "; ").alias("_alerts"),
        texts.general(c("mae")).alias("_mae"), texts.general(c("rmse")).alias("_rmse"), record.alias("_record"), unscored.alias("_unscored"),
    )


def batch_answers(questions: DataFrame, context: DataFrame, entity: str = "entity") -> DataFrame:
    """``questions`` (id columns, entity, query) answered against ``context``, one row per entity.

    Context columns: n_points, trend, slope_normalized, coefficient_of_variation, volatility,
    n_change_points, change_point_indices (of the forecast; n_points NULL if there is none), mae, rmse,
    mape, overall_score, threshold, overall_status, the alerts alert_mae, alert_mape, alert_drift with the
    values (monitored_mae, monitored_mape) and limits (mae_alert, mape_alert, drift_alert) they are about,
    and horizon, recorded_at, eval_status, eval_reason, eval_message (may be absent).

    The reply leads with the first intent and adds the others' signals, each sentence once.
    """
    c = F.col
    asked = questions.withColumn("intents", intent_tags(F.col("query")))
    joined = asked.join(_worded(context, entity), entity, "left")
    primary = F.get("intents", 0)

    def is_first(name: str) -> Column:
        return primary == name

    def has(name: str) -> Column:
        return F.array_contains("intents", name)

    described = c("n_points").isNotNull()
    trend_says, trend_why, swing_says, swing_why = c("_trend_says"), c("_trend_why"), c("_swing_says"), c("_swing_why")
    steps_says, steps_why, error_says, error_why = c("_steps_says"), c("_steps_why"), c("_error_says"), c("_error_why")
    drift_says, drift_why, mae, rmse = c("_drift_says"), c("_drift_why"), c("_mae"), c("_rmse")
    alerted = is_first("alert") & F.coalesce(c("_alerts") != "", F.lit(False))
    alerts_text = F.coalesce("_alerts", F.lit(""))
    status = F.coalesce("overall_status", F.lit("unknown"))
    asks_mae = F.lower("query").contains("mae")

    general = is_first("general")
    trend_second = described & has("trend") & ~is_first("trend") & ~is_first("forecast")
    steps_second = described & has("anomaly") & ~is_first("anomaly")
    error_second = (has("error") | general) & c("mape").isNotNull()
    drift_second = (has("drift") | general) & c("overall_score").isNotNull()

    says = [
        F.when(is_first("anomaly") & described, steps_says),
        F.when(is_first("trend") & described, trend_says),
        F.when(is_first("drift"), drift_says),
        F.when(is_first("error") & asks_mae, F.format_string(texts.MAE_LONG_SENTENCE, mae)),
        F.when(is_first("error"), error_says),
        F.when(is_first("forecast") & described, trend_says),
        F.when(is_first("forecast") & described, swing_says),
        F.when(is_first("health"), F.format_string(texts.STATUS_SENTENCE, status)),
        F.when(alerted, F.concat(F.lit(texts.ALERTS_SENTENCE), alerts_text)),
        F.when(trend_second, trend_says),
        F.when(steps_second, steps_says),
        F.when(error_second, error_says),
        F.when(drift_second, drift_says),
        F.when(general & described, swing_says),
    ]
    # "once each": a NULL format argument must not put the word "null" into a sentence
    says[3] = F.when(c("mae").isNotNull(), says[3])
    why = [
        _line("Query focus", F.concat(F.array_join("intents", ", "), F.lit("."))),
        F.when(is_first("anomaly") & described, _line("Anomaly / change points", steps_why)),
        F.when(is_first("trend") & described, _line("Trend", trend_why)),
        F.when(is_first("drift") & drift_why.isNotNull(), _line("Drift", drift_why)),
        F.when(is_first("error") & error_why.isNotNull(), _line("Error (MAPE)", error_why)),
        F.when(is_first("error") & c("mae").isNotNull(), F.format_string("- **MAE**: **%s**.", mae)),
        F.when(is_first("error") & c("rmse").isNotNull(), F.format_string("- **RMSE**: **%s**.", rmse)),
        F.when(is_first("forecast") & described, _line("Trend", trend_why)),
        F.when(is_first("forecast") & described, _line("Volatility", swing_why)),
        F.when(is_first("health"), F.concat(F.lit("- **Overall status**: `"), status, F.lit("`."))),
        F.when(alerted, _line("Alerts", alerts_text)),
        F.when(trend_second, _line("Trend", trend_why)),
        F.when(steps_second, _line("Change points", steps_why)),
        F.when(error_second & ~is_first("error") & ~(alerted & alerts_text.contains("MAPE")), _line("MAPE", error_why)),
        F.when(drift_second & ~is_first("drift"), _line("Drift", drift_why)),
        F.when(general & described, _line("Volatility", swing_why)),
    ]
    thin = (F.size("says") < 2) & c("mae").isNotNull()
    told = joined.withColumns({"says": F.array_distinct(F.array_compact(F.array(*says))), "why": F.array_compact(F.array(*why))})
    more = told.withColumns(
        {
            "says": F.when(thin, F.array_append("says", F.format_string(texts.MAE_SENTENCE, mae))).otherwise(c("says")),
            "why": F.when(thin, F.array_append("why", F.format_string("- **MAE**: **%s**.", mae))).otherwise(c("why")),
        }
    )
    answer = F.when(F.size("says") == 0, F.lit(texts.DEFAULT_ANSWER)).otherwise(F.array_join("says", " "))
    lines = F.concat("why", F.array_compact(F.array("_record", "_unscored")))
    reasoning = F.concat(F.lit(texts.REASONING_TITLE), F.array_join(lines, "\n"))
    metric_known = c("mae").isNotNull() | c("mape").isNotNull()
    confidence = (
        F.lit(0.45)
        + F.when(F.coalesce(c("n_points"), F.lit(0)) >= 7, 0.12).otherwise(0.0)
        + F.when(metric_known, 0.1).otherwise(0.0)
        + F.when(c("overall_score").isNotNull(), 0.08).otherwise(0.0)
        + F.least(F.lit(0.15), 0.03 * F.size("intents"))
    )
    bounded = round_stored(F.least(F.lit(0.92), F.greatest(F.lit(0.35), confidence)), 2)
    replied = more.select(
        *questions.columns, "intents", answer.alias("answer"), reasoning.alias("reasoning"), bounded.alias("confidence")
    )
    full = F.concat(F.lit("## Answer\n\n"), F.col("answer"), F.lit("\n\n"), F.col("reasoning"))
    return replied.withColumn("explanation", full)
