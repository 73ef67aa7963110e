"""Number formats for texts, and the fixed texts themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """``digits`` decimals of the number as it is stored in binary, an exact half to even.

    Java rounds the printed decimals instead, which differs for numbers like 78.35. The fraction is read
    as a whole number of 2^-52 steps, and the remainder compared with one half in decimals.
    """
    number = value.cast("double")
    size = F.abs(number)
    whole = F.floor(size)
    steps = (size - whole) * F.lit(2.0**52)  # exact, a power of two
    counted = F.floor(steps)
    unit, full = 10**digits, F.lit(2**52).cast("decimal(16,0)")
    product = counted.cast("decimal(16,0)") * F.lit(unit).cast("decimal(8,0)")
    rest = product % full
    down = ((product - rest) / full).cast("bigint")
    odd = (down if digits else whole) % 2 == 1
    up = (rest * 2 > full) | ((rest * 2 == full) & ((steps > counted) | odd))
    decimals = down + F.when(up, 1).otherwise(0)
    carried = whole + F.floor(decimals / unit)
    point = [F.lit("."), F.lpad((decimals % unit).cast("string"), digits, "0")] if digits else []
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(sign, carried.cast("string"), *point)
    return F.when(size < 1e15, exact).when(number.isNotNull(), F.format_string(f"%.{digits}f", number))


def general(value: Column, digits: int = 4) -> Column:
    """``digits`` significant digits without trailing zeros, scientific for very small or large numbers.

    Halves go to even on the printed decimals, which is exact for halves that binary can store; eight
    copies of the exact form would make too large an expression.
    """
    number, size = value.cast("double"), F.abs(value.cast("double"))
    text = F.when(number == 0, F.lit("0"))
    half = 0.5 * 10.0**-digits  # a number this close to the next power of ten is rounded up to it
    for power in range(-4, digits):
        within = (size >= 10.0**power * (1 - half)) & (size < 10.0 ** (power + 1) * (1 - half))
        places = digits - 1 - power
        text = text.when(within, F.format_string(f"%.{places}f", F.bround(number, places)))
    text = text.otherwise(F.format_string(f"%.{digits - 1}e", number))
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    return F.when(number.isNotNull(), trimmed)


def plain(value: Column, digits: int = 4) -> Column:
    """A rounded number as one would type it: at least one decimal, no trailing zeros."""
    return F.regexp_replace(fixed(value, digits), r"(\.\d+?)0+$", "$1")


# Keywords per intent, in the order in which intents are listed. They are matched as
# plain text inside the lower-cased question.
INTENT_WORDS = {
    "anomaly": ("anomaly", "spike", "jump", "sudden", "outlier", "change point", "changepoint", "break"),
    "drift": ("drift", "distribution shift", "covariate", "data shift", "population shift"),
    "alert": ("alert", "warning", "critical", "breach", "triggered", "firing"),
    "error": ("mae", "mape", "rmse", "mse", "error", "accuracy", "mistake", "wrong", "how good", "how bad"),
    "trend": ("trend", "increas", "decreas", "upward", "downward", "direction", "going up", "going down", "flat", "slope"),
    "forecast": ("forecast", "predict", "prediction", "projection"),
    "health": ("health", "status", "overview", "summary", "how is", "how are", "overall"),
}
GENERAL_INTENT = "general"

# Sentences of a series description. %s stands for a formatted number.
NOT_ENOUGH_SUMMARY = (
    "Not enough forecast points to characterize trend or volatility (need at least two numeric values)."
)
NOT_ENOUGH_LINE = "- **Data**: Fewer than two valid forecast values after parsing."
CONTEXT_LINE = "- **Metrics context**: "
NO_METRICS = "none supplied."
NO_KNOWN_METRICS = "provided but no standard keys (mae, rmse, mape) found."
TREND_LINES = {
    "stable_level": "- **Trend**: **Stable** — near-constant level (CV %s, normalized slope %s).",
    "upward": "- **Trend**: **Upward** — normalized slope vs dispersion is %s (above strong threshold 0.12).",
    "downward": "- **Trend**: **Downward** — normalized slope vs dispersion is %s (below -0.12).",
    "stable": "- **Trend**: **Stable** — normalized slope %s is within ±0.04 (flat pattern).",
    "moderate_up": "- **Trend**: **Moderate** — slightly upward drift (normalized slope %s).",
    "moderate_down": "- **Trend**: **Moderate** — slightly downward drift (normalized slope %s).",
}
TREND_PARTS = {
    "stable": "a **stable pattern**",
    "upward": "an **upward trend**",
    "downward": "a **downward trend**",
    "moderate_up": "a **slightly upward** trajectory",
    "moderate_down": "a **slightly downward** trajectory",
}
VOLATILE_LINE = (
    "- **Volatility**: **High** — coefficient of variation is %s "
    "(≥ 0.22: values swing strongly relative to typical level)."
)
CALM_LINE = "- **Volatility**: **Moderate or low** — CV %s is below the high-volatility cutoff (0.22)."
VOLATILE_PART = "**high volatility**"
STEPS_LINE = (
    "- **Anomalies**: **Sudden step changes** — %s step(s) exceed robust z-score 2.5 on first differences (indices [%s]%s)."
)
NO_STEPS_LINE = "- **Anomalies**: No sharp step changes detected vs robust spread of first differences."
STEPS_PART = "**sudden spikes or drops** between consecutive steps"
SUMMARY = (
    "The forecast series (%s points) shows %s. "
    "Analysis is rule-based (no LLM); confidence reflects series length and signal strength."
)

# Sentences and reasoning of an answer.
MAPE_SENTENCES = {
    "high": "Model error is relatively high, suggesting instability or noisy data.",
    "elevated": "Error is moderately elevated; treat point forecasts with extra caution.",
    "reasonable": "Point forecast error looks reasonable for many operational uses.",
}
MAPE_REASONS = {
    "high": "MAPE is about **%s%%**, above a typical 15–20%% watch band.",
    "elevated": "MAPE is about **%s%%** — worth monitoring against business tolerance.",
    "reasonable": "MAPE is about **%s%%**.",
}
DRIFT_SENTENCES = {
    "none": "No significant data drift detected; model assumptions remain broadly valid.",
    "below": "Drift is present but still below the alert threshold.",
    "elevated": "Data drift is elevated relative to the configured threshold; consider retraining or feature review.",
}
DRIFT_REASONS = {
    "none": "Drift score **%s** is well below threshold **%s**.",
    "below": "Drift score **%s** is under threshold **%s**.",
    "elevated": "Drift score **%s** meets or exceeds threshold **%s**.",
}
TREND_SENTENCES = {
    "up": "The forecast shows an upward trend, likely reflecting recent momentum in the historical pattern.",
    "down": "The forecast trends downward, consistent with a declining pattern in the series.",
    "flat": "The forecast is relatively flat with limited directional movement.",
}
TREND_REASONS = {
    "up": "Normalized slope **%s** over **%s** points indicates upward movement.",
    "down": "Normalized slope **%s** over **%s** points indicates downward movement.",
    "flat": "Normalized slope **%s** and **%s** points suggest a stable near-term path.",
}
TREND_TOO_SHORT = "Forecast series too short for a reliable trend read."
VOLATILITY_SENTENCES = {
    "high": "Volatility in the forecast path is high (large relative swings step-to-step).",
    "low_or_moderate": "Step-to-step volatility looks moderate or low compared with typical series noise.",
}
VOLATILITY_REASONS = {
    "high": "Coefficient of variation **%s** flags elevated relative variability.",
    "low_or_moderate": "Coefficient of variation **%s**.",
}
STEPS_SENTENCE = (
    "The forecast shows **%s** notable step change(s), which can indicate regime shifts or noisy inputs."
)
STEPS_REASON = "Indices with large jumps: **%s**%s."
NO_STEPS_SENTENCE = "No sudden step jumps stand out in the forecast window."
NO_STEPS_REASON = "No large step changes detected versus local baseline."
MAE_LONG_SENTENCE = "The holdout MAE is **%s** (mean absolute error vs actuals)."
MAE_SENTENCE = "Holdout MAE is **%s**."
STATUS_SENTENCE = "Overall monitoring status is **%s**."
ALERTS_SENTENCE = "These alerts fire when a live metric crosses its configured threshold. "
DEFAULT_ANSWER = (
    "Here is a quick read from the latest monitoring snapshot. "
    "Ask about trend, error, drift, or anomalies for a focused answer."
)
REASONING_TITLE = "### Reasoning (signals used)\n\n"

# What an evaluation without scores says, by reason; %s is the entity.
EVALUATION_MESSAGES = {
    "no_forecast_record": "No forecast has been recorded yet; run POST /api/v1/forecast/store or POST /api/v1/predict first.",
    "no_rows_for_store": "No rows in processed data for store_id=%s.",
    "no_overlapping_dates": "Forecast dates do not overlap finite actuals in processed data for this store.",
    "metrics_computation_failed": "Could not compute MAE/RMSE/MAPE from aligned pairs (no valid samples).",
}
#: Characters of such a message that a reply quotes.
QUOTED_MESSAGE = 240
