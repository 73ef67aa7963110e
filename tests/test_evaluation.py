import math

import pytest
from pyspark.sql import functions as F

from tsspark.config import MonitorConfig, PromotionConfig
from tsspark.operators import backtest as B
from tsspark.operators import drift as D
from tsspark.operators import evaluate as E
from tsspark.operators import history as H
from tsspark.operators import monitor as M

PAIRS = "date date, entity string, y_true double, y_pred double"
PANEL = "date date, entity string, target double"


@pytest.fixture
def ten(frame, days):
    def build(true, pred, entity="A"):
        return frame([(d, entity, float(t), float(p)) for d, t, p in zip(days("2024-01-01", len(true)), true, pred, strict=True)], PAIRS)

    return build


def test_known_errors(ten):
    row = E.metrics_global(ten([1, 2, 4], [2, 2, 2])).first()
    assert row["mae"] == 1.0 and row["rmse"] == pytest.approx(math.sqrt(5 / 3)) and row["mape"] == pytest.approx(50.0)


def test_mape_without_usable_actuals_is_missing(ten):
    assert E.metrics_global(ten([0, 0], [1, 1])).first()["mape"] is None


def test_entities_weigh_the_same(ten):
    pairs = ten([1, 1, 1, 1], [2, 2, 2, 2]).unionByName(ten([1], [6], "B")).unionByName(ten([0], [3], "C"))
    row = E.metrics_entity_mean(pairs).first()
    assert row["mae"] == 3.0 and row["mape"] == pytest.approx(300.0)  # C has no MAPE


def test_aligned_metrics_keep_finite_pairs(ten):
    pairs = ten([1, float("nan"), float("inf"), 3], [2, 1, 1, 3])
    row = E.aligned_metrics(pairs).first()
    assert (row["n_samples"], row["mae"]) == (2, 0.5)
    assert E.aligned_metrics(pairs.where("isnan(y_true)")).isEmpty()


def test_forecast_evaluation_reasons(frame, spark):
    forecasts = frame([("A", "2024-06-01", 100.0), ("A", "2024-06-02", 110.0), ("B", "2024-06-01", 1.0), ("C", "2024-06-01", 1.0)], "entity_id string, date date, y_pred double")
    actuals = frame([("2024-06-01", "A", 105.0), ("2024-06-02", "A", 108.0), ("2023-01-01", "B", 1.0)], PANEL)
    asked = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "entity string")
    got = {r["entity"]: r for r in E.evaluate_forecast(asked, forecasts, actuals).collect()}
    assert (got["A"]["status"], got["A"]["n_samples"], got["A"]["mae"]) == ("ok", 2, 3.5)
    assert [got[e]["reason"] for e in "BCD"] == ["no_overlapping_dates", "no_rows_for_store", "no_forecast_record"]


def test_latest_record_and_last_value_win(frame):
    records = frame(
        [("A", "2024-01-01", 1, "2024-02-01", 1.0), ("A", "2024-01-05", 1, "2024-02-01", 2.0), ("A", "2024-01-05", 2, "2024-02-01", 3.0)],
        "entity_id string, recorded_at date, step int, date date, y_pred double",
    )
    rows = E.latest_forecasts(records).collect()
    assert [(r["y_pred"], str(r["recorded_at"])) for r in rows] == [(3.0, "2024-01-05")]


def test_error_points_round_and_zero_actuals(ten):
    rows = H.error_points(ten([100, 0, 3], [90, 5, 2])).orderBy("date").collect()
    assert [(r["abs_error"], r["ape"]) for r in rows] == [(10.0, 0.1), (5.0, 0.0), (1.0, 0.33333333)]


def test_newer_scores_replace_older_ones(ten):
    history = H.append_errors(None, ten([100, 100], [90, 90]))
    out = H.append_errors(history, ten([100], [99])).orderBy("date").collect()
    assert [r["abs_error"] for r in out] == [1.0, 10.0]


def test_order_picks_among_new_scores(ten):
    twice = ten([100], [90]).withColumn("at", F.lit(1)).unionByName(ten([100], [95]).withColumn("at", F.lit(2)))
    assert H.append_errors(None, twice, order="at").first()["abs_error"] == 5.0


def test_history_is_capped_to_the_newest(ten):
    history = H.append_errors(None, ten(range(1, 11), [0] * 10))
    assert {str(r["date"]) for r in H.cap_history(history, limit=2).collect()} == {"2024-01-09", "2024-01-10"}


def test_rolling_series_starts_with_the_first_full_window(ten):
    history = H.append_errors(None, ten([100] * 5, [90, 100, 110, 100, 100]))
    rows = H.rolling_error_series(history, 3).orderBy("date").collect()
    assert [str(r["date"]) for r in rows] == ["2024-01-03", "2024-01-04", "2024-01-05"]
    assert rows[0]["mae"] == 6.666667 and rows[0]["mape"] == 6.6667
    with pytest.raises(ValueError):
        H.rolling_error_series(history, 1)
    with pytest.raises(ValueError):
        H.rolling_error_series(history, 91)
    assert H.rolling_error_series(history, 6).isEmpty()


def test_cutoffs_are_even_and_short_series_say_so(frame, days, spark):
    rows = [(d, "A", 1.0) for d in days("2024-01-01", 40)] + [(d, "B", 1.0) for d in days("2024-01-01", 22)]
    df = frame(rows, PANEL)
    got = B.backtest_cutoffs(df, 7, 3).orderBy("entity", "split").collect()
    assert [(r["entity"], r["status"], r["cutoff"]) for r in got] == [
        ("A", "ok", 15), ("A", "ok", 24), ("A", "ok", 33), ("B", "not_enough_dates", -1),
    ]
    assert [r["cutoff"] for r in B.backtest_cutoffs(df.where("entity = 'A'"), 7, 1).collect()] == [33]
    assert B.backtest_cutoffs(df.where("entity = 'A'"), 24, 20).count() == 1  # one position left


def test_backtest_equals_brute_force(frame, days):
    values = [float((i * 37) % 11 + i % 7) for i in range(60)]
    dates = [d for i, d in enumerate(days("2024-01-01", 80)) if i % 4 != 3][:60]
    df = frame([(d, "A", v) for d, v in zip(dates, values, strict=True)], PANEL)
    got = {r["split"]: r for r in B.backtest_naive(df, 7, 4).collect()}
    from datetime import date

    when = [date.fromisoformat(d) for d in dates]
    for split in range(4):
        c = 15 + round(split * ((60 - 7 - 15) / 3))
        points = []
        for j in range(c + 1, min(c + 7, 59) + 1):
            h = (when[j] - when[c]).days
            if h <= 7:
                points.append((values[j], values[c - 6 + (h - 1) % 7]))
        r = got[split + 1]
        assert r["horizon"] == len(points) and str(r["cutoff_date"]) == dates[c]
        assert r["mae"] == pytest.approx(sum(abs(a - b) for a, b in points) / len(points), abs=1e-4)


def test_averages_leave_out_undefined_mape(spark):
    splits = spark.createDataFrame(
        [("A", 1, 7, 2.0, 1.0, 10.0), ("A", 2, 6, 4.0, 2.0, None)], "entity string, split int, horizon int, rmse double, mae double, mape double"
    )
    row = B.backtest_average(splits).first()
    assert (row["n_splits"], row["rmse"], row["mae"], row["mape"]) == (2, 3.0, 1.5, 10.0)


def test_promotion_needs_every_metric(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, 1.0, None), (11.0, 1.0, 1.0)], "mae double, rmse double, mape double")
    assert [r["promote"] for r in E.promotion_gate(rows, PromotionConfig()).collect()] == [True, False, False]


def test_metric_series_and_reports(ten, frame):
    pairs = ten([1] * 10, [2] * 10)
    assert E.metric_series(pairs, "mae", "weekly").count() == 2 and E.metric_series(pairs, "rmse").count() == 10
    with pytest.raises(ValueError):
        E.metric_series(pairs, "mae", "hourly")
    forecasts = frame([("A", "2024-01-10", 5.0), ("A", "2024-01-11", 6.0)], "entity_id string, date date, y_pred double")
    actuals = pairs.select("entity", "date", F.col("y_true").alias("target"))
    both = E.historical_metrics(forecasts, actuals, "2024-01-09", "2024-01-31").orderBy("date").collect()
    assert [(r["actual"], r["forecast"], r["error"]) for r in both] == [(1.0, None, None), (1.0, 5.0, -4.0), (None, 6.0, None)]
    side = E.forecast_vs_actual(forecasts, actuals, forecasts).orderBy("date").collect()
    assert [(r["actual"], r["baseline"]) for r in side] == [(1.0, 5.0), (None, 6.0)]


# ---- drift


def halves(spark, ref, cur, feature="x"):
    rows = [("reference", feature, float(v)) for v in ref] + [("current", feature, float(v)) for v in cur]
    return spark.createDataFrame(rows, "half string, feature string, value double")


def test_equal_halves_do_not_drift_and_shifted_ones_do(spark):
    ref = list(range(1, 21))
    assert D.drift_scores(halves(spark, ref, reversed(ref)), 5).first()["score"] == pytest.approx(0.0, abs=1e-9)
    shifted = D.drift_scores(halves(spark, ref, [v + 10 for v in ref]), 5)
    assert D.drift_indicators(shifted).count() == 1
    assert D.drift_scores(halves(spark, ref, []), 5).first()["score"] == pytest.approx(1.0)
    assert D.drift_scores(halves(spark, ref, [1000] * 20), 5).first()["score"] == pytest.approx(1.0)


def test_bins_are_closed_as_in_numpy(spark):
    import numpy as np

    ref, cur = [0, 1, 2, 3, 4, 5, 10, 10], [0, 2, 4, 10, 10.00000000005, -1, 11]
    edges = np.linspace(0, 10, 6)
    edges[-1] += 1e-10
    long = halves(spark, ref, cur)
    got = D.histogram(long, D.fit_edges(long, 5, within=F.col("half") == "reference"), by=("half",))
    for half, values in (("reference", ref), ("current", cur)):
        expected = np.histogram(values, bins=edges)[0]
        counted = {r["bin"]: r["n"] for r in got.where(F.col("half") == half).collect()}
        assert [counted.get(i + 1, 0) for i in range(5)] == expected.tolist()


def test_edges_of_one_value_and_of_none(spark):
    assert D.fit_edges(halves(spark, [3], [])).first()["edges"] == [3.0, 3.0 + 1e-10]
    long = halves(spark, [], [1.0])
    assert D.fit_edges(long, within=F.col("half") == "reference").first()["edges"] == [0.0, 1.0]


def test_feature_drift_is_neutral_on_little_data(frame, days):
    row = D.feature_drift(frame([(d, "A", 1.0) for d in days("2024-01-01", 10)], PANEL)).first()
    assert not row["drift_detected"] and row["note"] == "insufficient rows for drift" and row["ref_sample_size"] == 10
    off = D.feature_drift(frame([("2024-01-01", "A", 1.0)], PANEL), MonitorConfig(drift_enabled=False)).first()
    assert off["note"] == "drift checks disabled in config"


def test_distribution_drift_levels(frame, days):
    d = days("2024-01-01", 80)
    shifted = frame([(x, "A", (100 if i < 40 else 200) + (i % 9) - 4.0) for i, x in enumerate(d)], PANEL)
    stable = frame([(x, "A", 50 + (i % 5) - 2.0) for i, x in enumerate(d)], PANEL)
    assert D.distribution_drift(shifted).first()["drift_score"] >= 0.5
    assert D.distribution_drift(stable).first()["status"] == "low"
    assert D.distribution_drift(stable.limit(2)).isEmpty()
    by_entity = D.distribution_drift_by_entity(shifted.unionByName(stable.withColumn("entity", F.lit("B"))))
    got = {r["entity"]: r["status"] for r in by_entity.collect()}
    assert got["B"] == "low" and got["A"] != "low"


def test_columns_preferred_then_numeric(spark):
    assert D.numeric_columns(spark.createDataFrame([(1, 2.0, "x", True)], "entity int, Sales double, name string, Promo boolean").schema) == ["Sales", "Promo"]
    assert D.numeric_columns(spark.createDataFrame([(1, 2.0, True)], "entity int, a double, b boolean").schema) == ["a", "b"]
    assert D.numeric_columns(spark.createDataFrame([(1.0, 2.0)], "target double, Sales double").schema, "target") == ["target", "Sales"]


# ---- monitoring


def test_perfect_known_and_high_errors(ten):
    config = MonitorConfig(window_days=3)
    perfect = M.performance_monitor(ten(range(10, 101, 10), range(10, 101, 10)), config).first()
    assert (perfect["rolling_mae"], perfect["alert_mae"], perfect["evaluated_points"]) == (0.0, False, 3)
    known = M.performance_monitor(ten(range(1, 11), [*range(1, 10), 12]), config).first()
    assert known["rolling_mae"] == pytest.approx(2 / 3)
    high = M.performance_monitor(ten([1] * 10, [1] * 7 + [10] * 3), config).first()
    assert high["rolling_mae"] == 9.0 and high["rolling_mape"] == pytest.approx(900.0)
    assert high["alert_mape"] and not high["alert_mae"]


def test_monitor_by_entity(ten):
    pairs = ten(range(1, 6), range(1, 6)).unionByName(ten([10, 20, 30, 40, 50], [10, 20, 30, 40, 50], "B"))
    row = M.performance_monitor(pairs, MonitorConfig(window_days=3), entity="entity").first()
    assert row["evaluated_points"] == 6 and row["rolling_mae"] == 0.0


def test_nothing_to_monitor(ten):
    row = M.performance_monitor(ten([1], [1]).limit(0)).first()
    assert row["evaluated_points"] == 0 and not row["alert_mae"] and row["mae"] is None


@pytest.mark.parametrize("score, found, status", [(0.1, False, "healthy"), (0.2, False, "warning"), (0.3, True, "critical")])
def test_status_from_drift(ten, spark, score, found, status):
    performance = M.performance_monitor(ten([1], [1]))
    moved = spark.createDataFrame([(found, score, 0.25)], "drift_detected boolean, overall_score double, threshold double")
    assert M.monitoring_status(performance, moved).first()["overall_status"] == status


def test_alerts_ignore_missing_metrics(spark):
    rows = spark.createDataFrame(
        [("a", None, None, False, 0.0), ("b", 16.0, 5.0, False, 0.0), ("c", 1.0, 21.0, False, 0.3)],
        "entity string, mae double, mape double, drift_detected boolean, overall_score double",
    )
    flagged = M.service_alerts(rows)
    assert {r["entity"]: r["overall_status"] for r in flagged.collect()} == {"a": "healthy", "b": "warning", "c": "warning"}
    listed = M.alert_rows(flagged, entity="entity").orderBy("entity", "alert_type").collect()
    assert [(r["entity"], r["alert_type"], r["current_value"]) for r in listed] == [("b", "MAE", 16.0), ("c", "Drift", 0.3), ("c", "MAPE", 21.0)]


def test_summary_mirrors_backtest(spark, frame):
    splits = frame(
        [("A", i + 1, f"2024-0{i + 1}-01", 7, 12.0 + i, 10.0 + i, 5.0 + i) for i in range(3)],
        "entity string, split int, cutoff_date date, horizon int, rmse double, mae double, mape double",
    )
    moved = spark.createDataFrame(
        [(True, 0.4, 0.25, {"x": 0.5, "y": 0.1})], "drift_detected boolean, overall_score double, threshold double, per_feature_scores map<string,double>"
    )
    rows = M.monitoring_from_backtest(splits, moved, "v3")
    summary = M.monitoring_summary(rows, entity="entity").first()
    assert summary["performance"]["sample_size"] == 21 and summary["performance"]["mae"] == 11.0
    assert [p["date"] for p in summary["rolling_series"]["mae"]] == ["2024-01-01", "2024-02-01", "2024-03-01"]
    assert [i["feature"] for i in summary["drift"]["indicators"]] == ["x"] and summary["drift"]["status"] == "drift_detected"
    assert summary["alerts"]["drift"] and summary["overall_status"] == "warning"
    snapshot = M.evaluation_snapshot(rows, entity="entity").first()
    assert snapshot["validation_mae"] is None and snapshot["rmse"] == 13.0
    asked = spark.createDataFrame([("A",), ("Z",)], "entity string")
    neutral = M.empty_summary(asked, rows).where("entity = 'Z'").first()
    assert (neutral["overall_status"], neutral["evaluated_points"], neutral["note"]) == ("unknown", 0, "no run recorded")


def test_reasons_come_with_a_message(frame, spark):
    forecasts = frame([("A", "2024-06-01", 100.0), ("B", "2024-06-01", 1.0), ("C", "2024-06-01", 1.0)], "entity_id string, date date, y_pred double")
    actuals = frame([("2024-06-01", "A", 105.0), ("2023-01-01", "B", 1.0)], PANEL)
    asked = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "entity string")
    got = {r["entity"]: r["message"] for r in E.evaluate_forecast(asked, forecasts, actuals).collect()}
    assert got["A"] is None and got["C"] == "No rows in processed data for store_id=C."
    assert got["B"].startswith("Forecast dates do not overlap") and got["D"].startswith("No forecast has been recorded yet")


def test_backtest_groups_hold_the_rows_near_a_cutoff(frame, days):
    from tsspark.operators.backtest import cutoff_rows

    values = [None if i == 24 else float(i) for i in range(40)]
    rows = [(d, "A", v) for d, v in zip(days("2024-01-01", 40), values, strict=True)] + [("2024-01-01", "B", 1.0)]
    got = cutoff_rows(frame(rows, PANEL), horizon=5, n_splits=3, tail=4).orderBy("split").collect()
    cuts = [15, 25, 35]
    assert [(r["entity"], r["split"], str(r["last_date"])) for r in got] == [("A", k + 1, days("2024-01-01", 40)[c]) for k, c in enumerate(cuts)]
    assert [list(r["hist"]) for r in got] == [values[c - 3 : c + 1] for c in cuts]
    assert [[x["y"] for x in r["ahead"]] for r in got] == [values[c + 1 : c + 6] for c in cuts]


def test_short_halves_are_reported_when_asked(frame, days):
    few = frame([(x, "A", float(i)) for i, x in enumerate(days("2024-01-01", 30))], PANEL)
    enough = frame([(x, "A", 50 + (i % 5) - 2.0) for i, x in enumerate(days("2024-01-01", 80))], PANEL)
    assert [(r["status"], r["drift_score"]) for r in D.distribution_drift(few, report_short=True).collect()] == [("not_enough_rows", None)]
    assert [r["status"] for r in D.distribution_drift(few.limit(0), report_short=True).collect()] == ["not_enough_rows"]
    assert [r["status"] for r in D.distribution_drift(enough, report_short=True).collect()] == ["low"]
