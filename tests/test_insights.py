import pytest
from pyspark.sql import functions as F

from tsspark.functions import texts
from tsspark.operators import answers as AN
from tsspark.operators import insights as I

SHAPES = {
    "up": [100, 102, 105, 110, 118, 130],
    "down": [200, 195, 188, 175, 160],
    "level": [50, 50.5, 49.8, 50.2, 50, 50.1],
    "volatile": [100, 180, 90, 200, 85, 190],
    "spike": [10, 10.1, 10, 10.2, 50, 10.1, 10],
    "short": [42],
    "broken": [float("nan"), float("inf"), None],
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(name, i + 1, None if v is None else float(v)) for name, values in SHAPES.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity_id string, step int, y_pred double")


def by_name(df, column="entity_id"):
    return {r[column]: r for r in df.collect()}


def test_labels_per_shape(series):
    got = by_name(I.describe_series(series))
    assert got["up"]["trend"] == "upward" and got["down"]["trend"] == "downward" and got["level"]["trend"] == "flat"
    assert got["volatile"]["volatility"] == "high" and got["level"]["volatility"] == "low_or_moderate"
    assert got["spike"]["n_change_points"] >= 1 and 4 in got["spike"]["change_point_indices"]
    assert got["short"]["trend"] == "insufficient" and got["short"]["volatility"] == "unknown"
    assert (got["broken"]["n_points"], got["broken"]["trend"]) == (0, "insufficient")


def test_slope_and_variation_equal_numpy(series):
    import numpy as np

    got = by_name(I.series_measures(series))
    y = np.array(SHAPES["up"], dtype=float)
    slope = np.polyfit(np.arange(len(y)), y, 1)[0] / (y.std(ddof=1) + 1e-9)
    assert got["up"]["slope"] == pytest.approx(slope)
    assert got["up"]["cv"] == pytest.approx(y.std(ddof=1) / (np.abs(y).mean() + 1e-9))


def test_texts_per_shape(series):
    got = by_name(I.insight_text(series))
    assert "upward" in got["up"]["summary"] and "downward" in got["down"]["summary"] and "stable" in got["level"]["summary"]
    assert "high volatility" in got["volatile"]["summary"] and "step" in got["spike"]["insights"]
    assert got["short"]["summary"].startswith("Not enough") and got["short"]["confidence"] < 0.5
    assert got["up"]["insights"].endswith("none supplied.")
    assert "near-constant level (CV 0.0047" in got["level"]["insights"]


def test_metrics_reach_the_text(series, spark):
    metrics = spark.createDataFrame([("up", 1.5, 12345.678, None)], "entity_id string, mae double, rmse double, mape double")
    got = by_name(I.insight_text(series, metrics))
    assert got["up"]["insights"].endswith("mae=1.5; rmse=1.235e+04.") and got["down"]["insights"].endswith("none supplied.")


@pytest.mark.parametrize("value", [0.0, 1.0, 78.125, 0.00012345, 1234.5678, 99999.0, 1e-7, -3.14159, 1e12, 9999.6, 9999.4, 0.00009999996, 0.000099, 0.5])
def test_general_format_equals_python(spark, value):
    got = spark.range(1).select(texts.general(F.lit(value))).first()[0]
    assert got == f"{value:.4g}"


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4])
def test_fixed_format_equals_python(spark, digits):
    import random

    rng = random.Random(digits)
    values = [78.35, 2.675, 0.125, 0.5, 1.5, 2.5, 999.9996, 0.9999999, 1e-9, 0.0, 123456789.05, 1e14 + 0.5]
    values += [round(rng.uniform(0, 200), 2) for _ in range(300)] + [rng.uniform(0, 1) for _ in range(100)]
    values += [-v for v in values if v]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", texts.fixed(F.col("v"), digits).alias("t")).collect():
        assert row["t"] == f"{row['v']:.{digits}f}", row["v"]


def test_fixed_and_plain_formats(spark):
    row = spark.range(1).select(
        texts.fixed(F.lit(0.125), 2), texts.fixed(F.lit(-0.0001), 3), texts.fixed(F.lit(None), 2), texts.plain(F.lit(0.5)), texts.plain(F.lit(2.0))
    ).first()
    assert tuple(row) == ("0.12", "-0.000", None, "0.5", "2.0")


@pytest.mark.parametrize(
    "text, tags",
    [
        ("Why did the MAE jump?", ["anomaly", "error"]),
        ("Any DRIFT alert today?", ["drift", "alert"]),
        ("Is the forecast increasing overall?", ["trend", "forecast", "health"]),
        ("Hello", ["general"]),
        (None, ["general"]),
    ],
)
def test_intents_in_fixed_order(spark, text, tags):
    assert spark.createDataFrame([(text,)], "t string").select(I.intent_tags(F.col("t"))).first()[0] == tags


def test_bands(spark):
    rows = spark.createDataFrame([(0.25, 0.1, 0.25), (17.0, 0.2, 0.25), (1.5, 0.25, None), (None, None, 0.25)], "mape double, overall_score double, threshold double")
    got = [(r["mape_band"], r["drift_band"]) for r in I.metric_bands(rows).collect()]
    assert got == [("high", "none"), ("elevated", "below"), ("reasonable", "elevated"), (None, None)]


def test_all_known_metrics_are_named(spark):
    series = spark.createDataFrame([("a", s, 10.0 + s) for s in range(1, 6)], "entity_id string, step int, y_pred double")
    metrics = spark.createDataFrame([("a", 1.5, 2.0, 2.5)], "entity_id string, mae double, mae_val double, rmse_val double")
    texts = " ".join(str(v) for v in I.insight_text(series, metrics).first())
    assert "mae=1.5; mae_val=2; rmse_val=2.5." in texts


def test_recent_points_keep_the_newest(spark):
    df = spark.range(250).select(F.lit("a").alias("entity_id"), F.col("id").alias("date"), F.col("id").cast("double").alias("y_pred"))
    assert I.recent_points(df).first()["n_points_included"] == 250
    row = I.recent_points(df, limit=100).first()
    assert (row["n_points_total"], row["n_points_included"], row["truncated"]) == (250, 100, True)
    assert [row["points"][0]["date"], row["points"][-1]["date"]] == [150, 249]


CONTEXT = (
    "entity string, n_points int, horizon int, recorded_at string, trend string, slope_normalized double, coefficient_of_variation double, volatility string, "
    "n_change_points int, change_point_indices array<int>, mae double, rmse double, mape double, monitored_mae double, monitored_mape double, "
    "overall_score double, threshold double, overall_status string, alert_mae boolean, alert_mape boolean, alert_drift boolean, "
    "mae_alert double, mape_alert double, drift_alert double, eval_status string, eval_reason string"
)


@pytest.fixture(scope="module")
def ask(spark):
    full = ("full", 7, 7, "2024-06-01", "upward", 0.35, 0.1, "high", 7, [1, 2, 3, 4, 5, 6, 7], 16.5, 20.0, 12.5, 16.5, 12.5, 0.1, 0.25, "warning", True, False, False, 15.0, 20.0, 0.25, "no_ground_truth", "no_overlapping_dates")
    bare = ("bare", *[None] * 25)
    context = spark.createDataFrame([full, bare], CONTEXT)

    def answer(entity, query):
        asked = spark.createDataFrame([(1, entity, query)], "id int, entity string, query string")
        return AN.batch_answers(asked, context).first()

    return answer


def test_answer_leads_with_the_first_intent(ask):
    row = ask("full", "Any spike? And what about the trend?")
    assert row["intents"] == ["anomaly", "trend"]
    assert row["answer"].startswith("The forecast shows **7** notable step change(s)") and "upward trend" in row["answer"]
    lines = row["reasoning"].split("\n")
    assert lines[2] == "- **Query focus**: anomaly, trend." and "**1, 2, 3, 4, 5** (+2 more)." in lines[3]
    assert "Normalized slope **0.35** over **7** points" in lines[4]
    assert lines[5] == "- **Latest forecast (API)**: store `full`, horizon `7`, `7` points, recorded `2024-06-01`."
    assert lines[6] == "- **Forecast vs actuals**: `no_overlapping_dates`"
    assert row["confidence"] == 0.81 and row["explanation"].startswith("## Answer\n\nThe forecast shows")


def test_answer_about_errors(ask):
    row = ask("full", "How good is the MAE?")
    assert row["answer"] == (
        "The holdout MAE is **16.5** (mean absolute error vs actuals). Point forecast error looks reasonable for many operational uses."
    )
    assert "- **RMSE**: **20**." in row["reasoning"] and row["reasoning"].count("MAPE is about **12.5%**") == 1


def test_answer_about_alerts(ask):
    row = ask("full", "Which alert was triggered?")
    assert "**MAE** (value `16.5` vs threshold `15.0`)" in row["answer"] and row["answer"].endswith("Holdout MAE is **16.5**.")


def test_general_answer_says_each_thing_once(ask):
    row = ask("full", "Tell me more")
    assert row["intents"] == ["general"]
    assert row["answer"].split(". ")[0].startswith("Point forecast error") and "No significant data drift" in row["answer"] and "Volatility in the forecast path is high" in row["answer"]


def test_answer_without_signals(ask):
    row = ask("bare", "What about drift?")
    assert row["answer"].startswith("Here is a quick read") and row["confidence"] == 0.48
    unknown = ask("nobody", "health please")
    assert unknown["answer"] == "Overall monitoring status is **unknown**."
