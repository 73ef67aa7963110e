"""Registered queries: series insights, intents and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsspark.functions import texts
from tsspark.operators import answers as AN
from tsspark.operators import evaluate as E
from tsspark.operators import forecast as FC
from tsspark.operators import insights as I
from tsspark.plans.catalog import MAE_SQL, MAPE_SQL, RMSE_SQL, SALES, cutoff_cte, naive_cte, pairs_cte, query, with_
from tsspark.plans.catalog_drift import DRIFT, OVERALL
from tsspark.plans.catalog_evaluation import AVERAGES, HELD_OUT, SALES_SPLITS, TRAIN, message_sql
from tsspark.plans.catalog_models import USER_DAYS, _sales, _user_days
from tsspark.plans.catalog_monitoring import CONFIG, _from_backtest
from tsspark.sources import panels

SERIES = {"entity": "entity", "step": "date", "value": "target"}



def measured_ctes(source: str, entity: str, order: str, value: str) -> tuple[str, ...]:
    """Positions, differences, anomalies, measures and labels of the series in ``source``."""
    return (
        f"""placed_points AS (SELECT {entity} AS entity, {value} AS y, row_number() OVER w - 1 AS i, {value} - lag({value}) OVER w AS d,
            count(*) OVER (PARTITION BY {entity}) AS n FROM {source} WINDOW w AS (PARTITION BY {entity} ORDER BY {order}))""",
        "middle AS (SELECT entity, quantile_cont(d, 0.5) AS m FROM placed_points GROUP BY entity)",
        """deviation AS (SELECT p.entity, quantile_cont(abs(d - m), 0.5) + 1e-9 AS mad, any_value(m) AS m
           FROM placed_points p JOIN middle q ON p.entity = q.entity GROUP BY p.entity)""",
        """flagged AS (SELECT p.*, coalesce(n >= 3 AND abs(d - m) / (1.4826 * mad) > 2.5, false) AS anomaly
           FROM placed_points p JOIN deviation q ON p.entity = q.entity)""",
        """measured AS (
            SELECT entity, count(*) AS n_points,
                   CASE WHEN count(*) >= 2 AND abs(regr_slope(y, i) / (stddev_samp(y) + 1e-9)) >= 1e-12 THEN regr_slope(y, i) / (stddev_samp(y) + 1e-9) ELSE 0 END AS slope,
                   CASE WHEN count(*) >= 2 THEN stddev_samp(y) / (avg(abs(y)) + 1e-9) ELSE 0 END AS cv,
                   coalesce(list(i ORDER BY i) FILTER (anomaly), []) AS changes FROM flagged GROUP BY entity)""",
        """shaped AS (SELECT *, len(changes) AS n_changes, CASE WHEN n_points < 2 THEN 'insufficient' WHEN cv < 0.02 AND abs(slope) < 0.18 THEN 'stable_level'
            WHEN slope > 0.12 THEN 'upward' WHEN slope < -0.12 THEN 'downward' WHEN abs(slope) < 0.04 THEN 'stable'
            WHEN slope > 0 THEN 'moderate_up' ELSE 'moderate_down' END AS shape FROM measured)""",
        """described AS (SELECT *, CASE WHEN shape IN ('stable', 'stable_level') THEN 'flat' ELSE shape END AS trend,
            CASE WHEN n_points < 2 THEN 'unknown' WHEN cv >= 0.22 THEN 'high' ELSE 'low_or_moderate' END AS volatility,
            CASE WHEN n_points < 2 THEN 0.2 ELSE round(least(0.92, greatest(0.18, 0.35 * least(1, n_points / 24) + 0.35 * least(1, abs(slope) / 0.25)
                + 0.15 * CASE WHEN cv > 0.08 THEN least(1, cv / 0.35) ELSE 0.35 END + 0.15 * least(1, 0.4 + 0.15 * least(n_changes, 4)))), 3) END AS confidence
            FROM shaped)""",
    )


# short, uneven series: event days per user
MEASURED = (USER_DAYS, *measured_ctes("user_days", "entity", "date", "target"))


@query(
    "series_measures",
    with_(*MEASURED, """SELECT entity, n_points, round(slope, 6) + 0.0 AS slope, round(cv, 6) AS cv, array_to_string(changes, ',') AS changes FROM measured"""),
)
def series_measures(spark, sf_dir):
    found = I.series_measures(_user_days(spark, sf_dir), **SERIES)
    return found.withColumn("changes", F.array_join(F.col("changes").cast("array<string>"), ","))


@query(
    "normalised_slope",
    with_(*MEASURED, "SELECT entity, round(slope, 6) + 0.0 AS slope FROM measured"),
)
def normalised_slope(spark, sf_dir):
    points = I.step_changes(_user_days(spark, sf_dir), **SERIES)
    return points.groupBy("entity").agg(I.normalised_slope(F.col("y"), F.col("i")).alias("slope"))


@query(
    "coefficient_of_variation",
    with_(SALES, "SELECT entity, round(stddev_samp(target) / (avg(abs(target)) + 1e-9), 6) AS cv FROM sales GROUP BY entity"),
)
def coefficient_of_variation(spark, sf_dir):
    return _sales(spark, sf_dir).groupBy("entity").agg(I.coefficient_of_variation(F.col("target")).alias("cv"))


@query("step_anomalies", with_(*MEASURED, "SELECT entity, i, y, d, anomaly FROM flagged"))
def step_anomalies(spark, sf_dir):
    return I.step_changes(_user_days(spark, sf_dir), **SERIES)


DESCRIBED = """entity, n_points, trend, round(slope, 4) + 0.0 AS slope_normalized, round(cv, 4) AS coefficient_of_variation, volatility,
    n_changes AS n_change_points, array_to_string(changes, ',') AS change_point_indices"""


@query("trend_label", with_(*MEASURED, f"SELECT {DESCRIBED} FROM described"))
def trend_label(spark, sf_dir):
    found = I.describe_series(_user_days(spark, sf_dir), **SERIES)
    return found.withColumn("change_point_indices", F.array_join(F.col("change_point_indices").cast("array<string>"), ","))


@query("insight_confidence", with_(*MEASURED, "SELECT entity, n_points, round(confidence, 6) AS confidence FROM described"))
def insight_confidence(spark, sf_dir):
    return I.insight_confidence(_user_days(spark, sf_dir), **SERIES)


def _text(template: str, *values: str) -> str:
    """A fixed text as a SQL expression: each %s replaced by an expression."""
    parts = template.split("%s")
    pieces = []
    for i, part in enumerate(parts):
        if part:
            pieces.append("'" + part.replace("%%", "%").replace("'", "''") + "'")
        if i < len(values):
            pieces.append(values[i])
    return f"concat({', '.join(pieces)})"


def _case(key: str, options: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in options.items()) + " END"


SLOPE3, CV3, CV4 = "printf('%.3f', slope)", "printf('%.3f', cv)", "printf('%.4f', cv)"
TREND_LINE = _case("shape", {k: _text(t, *([CV4, SLOPE3] if k == "stable_level" else [SLOPE3])) for k, t in texts.TREND_LINES.items()})
TREND_PART = _case("shape", {**{k: _text(t) for k, t in texts.TREND_PARTS.items()}, "stable_level": _text(texts.TREND_PARTS["stable"])})
MORE = "CASE WHEN n_changes > 5 THEN concat(' (+', n_changes - 5, ' more)') ELSE '' END"
FIRST = "array_to_string(changes[1:5], ', ')"


@query(
    "insight_text",
    with_(
        *MEASURED,
        f"""metrics AS (SELECT entity AS e, {MAE_SQL} AS mae, {RMSE_SQL} AS rmse, {MAPE_SQL} AS mape FROM
            (SELECT entity, target AS y_true, lag(target, 7) OVER (PARTITION BY entity ORDER BY date) AS y_pred FROM user_days) WHERE y_pred IS NOT NULL GROUP BY 1)""",
        f"""lines AS (SELECT *, {TREND_LINE} AS trend_line, list_filter([{TREND_PART}, CASE WHEN cv >= 0.22 THEN {_text(texts.VOLATILE_PART)} END,
                CASE WHEN n_changes > 0 THEN {_text(texts.STEPS_PART)} END], lambda x: x IS NOT NULL) AS parts,
                CASE WHEN e IS NULL THEN {_text(texts.NO_METRICS)}
                     ELSE concat(concat_ws('; ', 'mae=' || printf('%.4g', mae), 'rmse=' || printf('%.4g', rmse), 'mape=' || printf('%.4g', mape)), '.') END AS known
            FROM described LEFT JOIN metrics ON e = entity)""",
        f"""SELECT entity, CASE WHEN n_points < 2 THEN {_text(texts.NOT_ENOUGH_SUMMARY)} ELSE {_text(texts.SUMMARY, 'n_points',
                "concat(array_to_string(parts[1:2], ', '), CASE WHEN len(parts) > 2 THEN ', with ' || parts[3] ELSE '' END)")} END AS summary,
            CASE WHEN n_points < 2 THEN concat({_text(texts.NOT_ENOUGH_LINE)}, chr(10), {_text(texts.CONTEXT_LINE)}, known)
                 ELSE concat_ws(chr(10), trend_line, CASE WHEN cv >= 0.22 THEN {_text(texts.VOLATILE_LINE, CV3)} ELSE {_text(texts.CALM_LINE, CV3)} END,
                    CASE WHEN n_changes > 0 THEN {_text(texts.STEPS_LINE, 'n_changes', FIRST, MORE)} ELSE {_text(texts.NO_STEPS_LINE)} END,
                    concat({_text(texts.CONTEXT_LINE)}, known)) END AS insights,
            CASE WHEN n_points < 2 THEN 0.15 ELSE round(confidence, 6) END AS confidence FROM lines""",
    ),
)
def insight_text(spark, sf_dir):
    days = _user_days(spark, sf_dir)
    metrics = E.metrics_by_entity(panels.forecast_pairs(days))
    return I.insight_text(days, metrics, **SERIES)


BANDS = """CASE WHEN CASE WHEN mape <= 1 THEN mape * 100 ELSE mape END >= 20 THEN 'high' WHEN CASE WHEN mape <= 1 THEN mape * 100 ELSE mape END >= 15 THEN 'elevated'
    WHEN mape IS NOT NULL THEN 'reasonable' END AS mape_band,
    CASE WHEN overall_score < 0.125 THEN 'none' WHEN overall_score < 0.25 THEN 'below' WHEN overall_score IS NOT NULL THEN 'elevated' END AS drift_band"""


@query(
    "metric_bands",
    with_(
        USER_DAYS, pairs_cte("user_days"),
        f"bands AS (SELECT entity, {MAPE_SQL} / 4 AS mape, stddev_samp(y_pred) / 10 AS overall_score FROM pairs GROUP BY entity)",
        f"SELECT entity, round(mape, 6) AS mape, round(overall_score, 6) AS overall_score, CAST(0.25 AS DOUBLE) AS threshold, {BANDS} FROM bands",
    ),
)
def metric_bands(spark, sf_dir):
    """Scaled scores of each user, spread over all bands."""
    pairs = panels.forecast_pairs(_user_days(spark, sf_dir))
    spread = pairs.groupBy("entity").agg(
        (E.point_metrics()[2] / 4).alias("mape"), (F.stddev_samp("y_pred") / 10).alias("overall_score")
    )
    return I.metric_bands(spread.withColumn("threshold", F.lit(0.25)))


# fixed question openings, one per kind of event, on working days and at weekends
ASKED = {
    "view": "How is the forecast trending",
    "click": "Any spike or sudden jump",
    "purchase": "Is there data drift or an alert",
    "error": "What is the MAE and overall accuracy",
    "signup": "Which alert was triggered",
}
ASKED_AT_WEEKENDS = {
    "view": "Predict next week",
    "click": "Overall status please",
    "purchase": "Tell me more",
    "error": "How bad is it, and is there drift",
    "signup": "Is the slope flat, or is there an outlier",
}


def _questions(spark, sf_dir):
    """One question per event about the supplier of the same number as its user."""
    events = panels.table(spark, sf_dir, "events")

    def opening(asked):
        return F.coalesce(*[F.when(F.col("event_type") == k, F.lit(q)) for k, q in asked.items()])

    chosen = F.when(F.weekday("ts") >= 5, opening(ASKED_AT_WEEKENDS)).otherwise(opening(ASKED))
    return events.select("event_id", F.col("user_id").alias("entity"), F.concat(chosen, F.lit(" for "), "event_type", F.lit("?")).alias("query"))


def _opening(asked: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{q}'" for k, q in asked.items()) + " END"


INTENTS = ", ".join(f"CASE WHEN regexp_matches(q, '{'|'.join(words)}') THEN '{name}' END" for name, words in texts.INTENT_WORDS.items())
OPENING = f"CASE WHEN isodow(ts) >= 6 THEN {_opening(ASKED_AT_WEEKENDS)} ELSE {_opening(ASKED)} END"
QUESTION = f"concat({OPENING}, ' for ', event_type, '?')"


@query(
    "intent_tags",
    f"""SELECT kind, id, turn, coalesce(nullif(concat_ws(',', {INTENTS}), ''), 'general') AS intents FROM (
        SELECT 'conversation' AS kind, conv_id AS id, turn, lower(text) AS q FROM conversations
        UNION ALL SELECT 'document', doc_id, 0, lower(text) FROM documents
        UNION ALL SELECT 'question', event_id, 0, lower({QUESTION}) FROM events)""",
)
def intent_tags(spark, sf_dir):
    said = panels.table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    written = panels.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).alias("turn"), "text")
    asked = _questions(spark, sf_dir).select(F.lit("question").alias("kind"), F.col("event_id").alias("id"), F.lit(0).alias("turn"), F.col("query").alias("text"))
    everything = said.unionByName(written).unionByName(asked)
    return everything.select("kind", "id", "turn", F.array_join(I.intent_tags(F.col("text")), ",").alias("intents"))


def _context(spark, sf_dir):
    train, held_out = FC.time_split(_sales(spark, sf_dir))
    made = FC.seasonal_naive(train, 14).withColumn("recorded_at", F.date_sub("date", F.col("step")))
    requested = _sales(spark, sf_dir).groupBy("entity").agg(F.lit(1).alias("one")).drop("one")
    scored = E.evaluate_forecast(requested, made, held_out)
    return made, I.insight_context(made, scored, _from_backtest(spark, sf_dir))


CONTEXT = (
    *SALES_SPLITS, AVERAGES, *DRIFT, OVERALL,
    cutoff_cte("sales"), TRAIN, HELD_OUT, naive_cte("train", 14),
    """latest AS (SELECT entity_id, count(*) AS n_points, max(step) AS horizon, max(date - step) AS recorded_at FROM naive GROUP BY 1)""",
    f"""evaluated AS (SELECT entity_id, {MAE_SQL} AS mae, {RMSE_SQL} AS rmse, {MAPE_SQL} AS mape, count(*) AS n_samples FROM (
        SELECT n.entity_id, h.target AS y_true, y_pred FROM naive n JOIN held_out h ON h.entity = n.entity_id AND h.date = n.date) GROUP BY 1)""",
    """context AS (
        SELECT a.entity, l.n_points, l.horizon, l.recorded_at, CASE WHEN n_samples > 0 THEN 'ok' ELSE 'no_ground_truth' END AS eval_status,
               CASE WHEN n_samples > 0 THEN NULL WHEN l.n_points IS NULL THEN 'no_forecast_record'
                    WHEN a.entity NOT IN (SELECT entity FROM held_out) THEN 'no_rows_for_store' ELSE 'no_overlapping_dates' END AS eval_reason,
               CASE WHEN n_samples > 0 THEN v.mae ELSE a.mae END AS mae, CASE WHEN n_samples > 0 THEN v.rmse ELSE a.rmse END AS rmse,
               CASE WHEN n_samples > 0 THEN v.mape ELSE coalesce(a.mape, 0) END AS mape,
               CASE WHEN n_samples > 0 THEN n_samples ELSE points END AS sample_size,
               CASE WHEN n_samples > 0 THEN 'last_forecast_vs_actuals' ELSE 'rolling_backtest' END AS source,
               a.mae AS monitored_mae, coalesce(a.mape, 0) AS monitored_mape, drift_detected, overall_score, threshold
        FROM averages a LEFT JOIN latest l ON l.entity_id = a.entity LEFT JOIN evaluated v ON v.entity_id = a.entity
        JOIN (SELECT entity, CAST(sum(horizon) AS BIGINT) AS points FROM splits GROUP BY 1) p ON p.entity = a.entity, overall)""",
)


@query(
    "insight_context",
    with_(*CONTEXT, """SELECT entity, n_points, horizon, CAST(recorded_at AS VARCHAR) AS recorded_at, eval_status, eval_reason, """ + message_sql("eval_reason", "entity") + """ AS eval_message,
          round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, sample_size, source, monitored_mae, monitored_mape, drift_detected, round(overall_score, 6) AS overall_score, threshold FROM context"""),
)
def insight_context(spark, sf_dir):
    _, context = _context(spark, sf_dir)
    return context.drop("alert_mae", "alert_mape", "alert_drift", "overall_status")


@query(
    "recent_points",
    with_(
        SALES,
        """SELECT entity AS entity_id, CAST(date AS VARCHAR) AS date, target AS y_pred, total AS n_points_total, least(total, 100) AS n_points_included,
                  total > 100 AS truncated
           FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY entity) AS total FROM sales)
           WHERE back <= 100""",
    ),
)
def recent_points(spark, sf_dir):
    series = _sales(spark, sf_dir).select(F.col("entity").alias("entity_id"), "date", F.col("target").alias("y_pred"))
    kept = I.recent_points(series, limit=100)
    return kept.select("entity_id", F.inline("points"), "n_points_total", "n_points_included", "truncated")


@query(
    "all_points",
    with_(
        SALES,
        """SELECT entity AS entity_id, CAST(date AS VARCHAR) AS date, target AS y_pred, total AS n_points_total, total AS n_points_included,
                  false AS truncated
           FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY entity) AS total FROM sales)""",
    ),
)
def all_points(spark, sf_dir):
    series = _sales(spark, sf_dir).select(F.col("entity").alias("entity_id"), "date", F.col("target").alias("y_pred"))
    kept = I.recent_points(series)
    return kept.select("entity_id", F.inline("points"), "n_points_total", "n_points_included", "truncated")


def _options(key: str, options: dict[str, str], *values: str) -> str:
    return _case(key, {k: _text(t, *values) for k, t in options.items()})


def _answers_sql() -> str:
    """Answers from the same fixed texts: which sentence applies, and in which order, spelled out in SQL."""
    slope, variation = "CAST(round(slope, 4) + 0.0 AS VARCHAR)", "CAST(round(cv, 4) AS VARCHAR)"
    mae, rmse = "printf('%.4g', mae)", "printf('%.4g', rmse)"
    more = "CASE WHEN n_changes > 5 THEN concat(' (+', n_changes - 5, ' more)') ELSE '' END"
    steps_says = f"CASE WHEN n_changes > 0 THEN {_text(texts.STEPS_SENTENCE, 'n_changes')} ELSE {_text(texts.NO_STEPS_SENTENCE)} END"
    steps_why = f"CASE WHEN n_changes > 0 THEN {_text(texts.STEPS_REASON, FIRST, more)} ELSE {_text(texts.NO_STEPS_REASON)} END"
    trend_why = f"coalesce({_options('way', texts.TREND_REASONS, slope, 'n_points')}, {_text(texts.TREND_TOO_SHORT)})"
    said = f"""
        CASE WHEN lead = 'anomaly' AND known THEN {steps_says} END, CASE WHEN lead = 'trend' AND known THEN trend_says END,
        CASE WHEN lead = 'drift' THEN drift_says END, CASE WHEN lead = 'error' AND contains(lower(query), 'mae') AND mae IS NOT NULL THEN {_text(texts.MAE_LONG_SENTENCE, mae)} END,
        CASE WHEN lead = 'error' THEN error_says END, CASE WHEN lead = 'forecast' AND known THEN trend_says END, CASE WHEN lead = 'forecast' AND known THEN swing_says END,
        CASE WHEN lead = 'health' THEN {_text(texts.STATUS_SENTENCE, "coalesce(overall_status, 'unknown')")} END,
        CASE WHEN alerted THEN concat({_text(texts.ALERTS_SENTENCE)}, alerts) END, CASE WHEN trend_second THEN trend_says END,
        CASE WHEN known AND list_contains(intents, 'anomaly') AND lead <> 'anomaly' THEN {steps_says} END,
        CASE WHEN (list_contains(intents, 'error') OR lead = 'general') AND mape IS NOT NULL THEN error_says END,
        CASE WHEN (list_contains(intents, 'drift') OR lead = 'general') AND overall_score IS NOT NULL THEN drift_says END,
        CASE WHEN lead = 'general' AND known THEN swing_says END"""
    why = f"""
        concat('- **Query focus**: ', array_to_string(intents, ', '), '.'),
        CASE WHEN lead = 'anomaly' AND known THEN concat('- **Anomaly / change points**: ', {steps_why}) END,
        CASE WHEN lead = 'trend' AND known THEN concat('- **Trend**: ', {trend_why}) END,
        CASE WHEN lead = 'drift' THEN '- **Drift**: ' || drift_why END, CASE WHEN lead = 'error' THEN '- **Error (MAPE)**: ' || error_why END,
        CASE WHEN lead = 'error' AND mae IS NOT NULL THEN concat('- **MAE**: **', {mae}, '**.') END,
        CASE WHEN lead = 'error' AND rmse IS NOT NULL THEN concat('- **RMSE**: **', {rmse}, '**.') END,
        CASE WHEN lead = 'forecast' AND known THEN concat('- **Trend**: ', {trend_why}) END,
        CASE WHEN lead = 'forecast' AND known THEN concat('- **Volatility**: ', swing_why) END,
        CASE WHEN lead = 'health' THEN concat('- **Overall status**: `', coalesce(overall_status, 'unknown'), '`.') END,
        CASE WHEN alerted THEN concat('- **Alerts**: ', alerts) END, CASE WHEN trend_second THEN concat('- **Trend**: ', {trend_why}) END,
        CASE WHEN known AND list_contains(intents, 'anomaly') AND lead <> 'anomaly' THEN concat('- **Change points**: ', {steps_why}) END,
        CASE WHEN (list_contains(intents, 'error') OR lead = 'general') AND lead <> 'error' AND NOT (alerted AND contains(alerts, 'MAPE')) THEN '- **MAPE**: ' || error_why END,
        CASE WHEN (list_contains(intents, 'drift') OR lead = 'general') AND lead <> 'drift' THEN '- **Drift**: ' || drift_why END,
        CASE WHEN lead = 'general' AND known THEN '- **Volatility**: ' || swing_why END"""
    percent = "CASE WHEN mape <= 1 THEN mape * 100 ELSE mape END"
    return with_(
        *CONTEXT,
        *measured_ctes("naive", "entity_id", "step", "y_pred"),
        f"""asked AS (SELECT event_id, user_id AS entity, {QUESTION} AS query FROM events)""",
        f"""tagged AS (SELECT *, CASE WHEN len(found) = 0 THEN ['general'] ELSE found END AS intents FROM (
                SELECT event_id, entity, query, list_filter([{INTENTS}], lambda x: x IS NOT NULL) AS found FROM (SELECT *, lower(query) AS q FROM asked)))""",
        f"""joined AS (
            SELECT t.event_id, t.entity, t.query, t.intents, t.intents[1] AS lead, c.* EXCLUDE (entity), d.slope, d.cv, d.trend, d.volatility, d.changes, d.n_changes,
                   c.n_points IS NOT NULL AS known, {BANDS},
                   list_filter([CASE WHEN monitored_mae > 16 THEN concat('**MAE** (value `', CAST(monitored_mae AS VARCHAR), '` vs threshold `16.0`)') END,
                                CASE WHEN monitored_mape > 150 THEN concat('**MAPE** (value `', CAST(monitored_mape AS VARCHAR), '` vs threshold `150.0`)') END,
                                CASE WHEN overall_score > 0.25 THEN concat('**Drift** (value `', CAST(overall_score AS VARCHAR), '` vs threshold `0.25`)') END],
                               lambda x: x IS NOT NULL) AS raised,
                   CASE WHEN monitored_mae > 16 OR monitored_mape > 150 OR overall_score > 0.25 THEN 'warning' WHEN c.entity IS NOT NULL THEN 'healthy' END AS overall_status,
                   CASE WHEN trend IN ('upward', 'moderate_up') THEN 'up' WHEN trend IN ('downward', 'moderate_down') THEN 'down' WHEN trend <> 'insufficient' THEN 'flat' END AS way
            FROM tagged t LEFT JOIN context c ON c.entity = t.entity LEFT JOIN described d ON d.entity = c.entity)""",
        f"""worded AS (SELECT *, array_to_string(raised, '; ') AS alerts, lead = 'alert' AND len(raised) > 0 AS alerted,
                   known AND list_contains(intents, 'trend') AND lead NOT IN ('trend', 'forecast') AS trend_second,
                   {_options('way', texts.TREND_SENTENCES)} AS trend_says, {_options('volatility', texts.VOLATILITY_SENTENCES)} AS swing_says,
                   {_options('volatility', texts.VOLATILITY_REASONS, variation)} AS swing_why,
                   {_options('mape_band', texts.MAPE_SENTENCES)} AS error_says, {_options('mape_band', texts.MAPE_REASONS, f"printf('%.1f', {percent})")} AS error_why,
                   {_options('drift_band', texts.DRIFT_SENTENCES)} AS drift_says,
                   {_options('drift_band', texts.DRIFT_REASONS, "printf('%.3f', overall_score)", "printf('%.3f', threshold)")} AS drift_why
            FROM joined)""",
        f"""listed AS (SELECT *, list_filter([{said}], lambda x: x IS NOT NULL) AS repeated, list_filter([{why}], lambda x: x IS NOT NULL) AS reasons FROM worded)""",
        "once AS (SELECT *, list_filter(repeated, lambda x, i: list_position(repeated, x) = i) AS said FROM listed)",
        f"""replied AS (SELECT event_id, entity, query, array_to_string(intents, ',') AS intents,
                   CASE WHEN len(said) = 0 AND mae IS NULL THEN {_text(texts.DEFAULT_ANSWER)}
                        ELSE concat_ws(' ', nullif(array_to_string(said, ' '), ''), CASE WHEN len(said) < 2 AND mae IS NOT NULL THEN {_text(texts.MAE_SENTENCE, mae)} END) END AS answer,
                   concat('### Reasoning (signals used)', chr(10), chr(10), concat_ws(chr(10), array_to_string(reasons, chr(10)),
                       CASE WHEN len(said) < 2 AND mae IS NOT NULL THEN concat('- **MAE**: **', {mae}, '**.') END,
                       CASE WHEN known THEN concat('- **Latest forecast (API)**: store `', entity, '`, horizon `', horizon, '`, `', n_points, '` points, recorded `', CAST(recorded_at AS VARCHAR), '`.') END,
                       CASE WHEN eval_status <> 'ok' AND eval_reason <> 'no_forecast_record' THEN concat('- **Forecast vs actuals**: `', eval_reason, '` — ', left({message_sql('eval_reason', 'entity')}, {texts.QUOTED_MESSAGE})) END)) AS reasoning,
                   round(least(0.92, greatest(0.35, 0.45 + CASE WHEN coalesce(n_points, 0) >= 7 THEN 0.12 ELSE 0 END + CASE WHEN mae IS NOT NULL OR mape IS NOT NULL THEN 0.1 ELSE 0 END
                       + CASE WHEN overall_score IS NOT NULL THEN 0.08 ELSE 0 END + least(0.15, 0.03 * len(intents)))), 2) AS confidence FROM once)""",
        "SELECT *, concat('## Answer', chr(10), chr(10), answer, chr(10), chr(10), reasoning) AS explanation FROM replied",
    )


ANSWERS_SQL = _answers_sql()


@query("batch_answers", ANSWERS_SQL)
def batch_answers(spark, sf_dir):
    """Questions about suppliers, answered from their forecast, its evaluation and the monitoring row."""
    made, context = _context(spark, sf_dir)
    shape = I.describe_series(made).withColumnRenamed("entity_id", "entity").drop("n_points")
    limits = {"mae_alert": F.lit(CONFIG.mae_alert), "mape_alert": F.lit(CONFIG.mape_alert), "drift_alert": F.lit(CONFIG.drift_threshold)}
    replies = AN.batch_answers(_questions(spark, sf_dir), context.join(shape, "entity", "left").withColumns(limits))
    return replies.withColumn("intents", F.array_join("intents", ","))
