import random
from datetime import date, timedelta

import pytest

from tsspark.operators.history import append_errors, rolling_error_series
from tsspark.session import scratch_path
from tsspark.streaming import feeds, rolling

PAIRS = "entity string, date date, y_true double, y_pred double, at long"


def brute(points, window):
    days = sorted(points)
    return {d: (sum(points[x][0] for x in days[k - window + 1 : k + 1]) / window, 100 * sum(points[x][1] for x in days[k - window + 1 : k + 1]) / window) for k, d in enumerate(days) if k >= window - 1}


@pytest.mark.parametrize("lateness", [0, 5, 40])
def test_ring_emits_the_windows_a_point_changes(lateness):
    rng, window = random.Random(lateness), 4
    ring, points, emitted, late = rolling.Ring(window, lateness, [], [], False), {}, {}, 0
    for _ in range(400):
        day = max(points, default=100) + rng.randint(-30, 6)
        point = (rng.randint(0, 50) / 2, rng.randint(0, 8) / 8)
        was_late = ring.late(day)
        late += was_late
        points[day] = point
        ring.put(day, point)
        emitted |= {ring.days[k]: ring.means(k) for k in ring.touched([day])}
        if was_late:  # the sink computes these from all points
            emitted |= brute(points, window)
        ring.shrink()
        assert emitted == {d: pytest.approx(m, abs=1e-4) for d, m in brute(points, window).items()}
        inside = sum(d > max(points) - lateness for d in points)
        assert len(ring.days) <= inside + 2 * window + 30
    assert late > 0 if lateness < 30 else late == 0


def deliveries(days=40, parts=6, seed=3):
    """Shuffled pairs of three entities, some far behind, some corrected later."""
    rng = random.Random(seed)
    rows = [(e, (date(2024, 1, 1) + timedelta(days=d)).isoformat(), float(rng.randint(1, 9)), float(rng.randint(1, 9)), 1) for e in "abc" for d in range(days) if rng.random() < 0.8]
    order = sorted(rows, key=lambda r: date.fromisoformat(r[1]).toordinal() + rng.gauss(0, 8))
    cut = [order[k * len(order) // parts : (k + 1) * len(order) // parts] for k in range(parts)]
    cut[-1] += [(e, d, y, y, 2) for e, d, y, _, _ in rng.sample(rows, 5)]
    return cut


def test_equals_the_batch_series_after_out_of_order_deliveries_and_restarts(spark, frame):
    arriving, progress = scratch_path(spark, "in"), scratch_path(spark, "progress")
    errors = feeds.errors_table(spark, scratch_path(spark, "errors"))
    windows = rolling.rolling_table(spark, scratch_path(spark, "windows"))
    sent, late = [], 0
    for rows in deliveries():
        frame(rows, PAIRS).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(frame(rows, PAIRS).schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        query = rolling.rolling_sink(stream, 5, 7, errors, windows, progress, "at")  # each delivery starts the stream again
        query.awaitTermination()
        sent += rows
        state = query.lastProgress["stateOperators"][0]
        assert state["numRowsTotal"] <= 3
    batch = rolling_error_series(append_errors(None, frame(sent, PAIRS), order="at"), 5)
    got = {(r["entity"], r["date"]): (r["mae"], r["mape"]) for r in windows.read().collect()}
    assert got == {(r["entity"], r["date"]): (r["mae"], r["mape"]) for r in batch.collect()}
    points = {(r["entity"], r["date"]): (r["abs_error"], r["ape"]) for r in errors.read().collect()}
    assert points == {(r["entity"], r["date"]): (r["abs_error"], r["ape"]) for r in append_errors(None, frame(sent, PAIRS), order="at").collect()}


def test_bounds_of_the_window(spark, frame):
    points = append_errors(None, frame([("a", "2024-01-01", 1.0, 2.0, 1)], PAIRS))
    for window, lateness in ((1, 3), (91, 3), (5, -1)):
        with pytest.raises(ValueError, match="window"):
            rolling.rolling_stream(points, window, lateness)
