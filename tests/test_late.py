import random
from datetime import date, timedelta

import pytest
from pyspark.sql import types as T

from tsspark.session import scratch_path
from tsspark.sources.commits import Folder
from tsspark.sources.keyed import KeyedTable
from tsspark.streaming import late

FIELDS = "entity string, date date, target double"
SCHEMA = T.StructType().add("entity", T.StringType()).add("date", T.DateType()).add("target", T.DoubleType())


def deliveries(seed=5, days=60, parts=5):
    rng = random.Random(seed)
    rows = [(e, (date(2024, 1, 1) + timedelta(days=d)).isoformat(), float(d)) for e in "abcd" for d in range(days)]
    order = sorted(rows, key=lambda r: date.fromisoformat(r[1]).toordinal() + (rng.random() < 0.1) * rng.randint(0, 50))
    cut = [order[k * len(order) // parts : (k + 1) * len(order) // parts] for k in range(parts)]
    for k, part in enumerate(cut[1:], 1):
        part += [(e, d, y + 1000 * k) for e, d, y in rng.sample(cut[k - 1], 4)]
    return cut


def as_rows(df):
    return sorted((r["entity"], r["date"].isoformat(), r["target"]) for r in df.collect())


def test_both_tables_add_up_and_state_stays_bounded(spark, frame):
    arriving, progress, side = (scratch_path(spark, n) for n in ("in", "progress", "side"))
    panel, sent, fates = KeyedTable(spark, scratch_path(spark, "panel"), SCHEMA, ("entity", "date")), [], set()
    for rows in deliveries():
        frame(rows, FIELDS).coalesce(1).write.mode("append").parquet(arriving)
        query = late.late_sales_sink(spark.readStream.schema(SCHEMA).parquet(arriving), 7, panel, side, progress)
        query.awaitTermination()
        sent += rows
        state = query.lastProgress["stateOperators"][0]
        assert state["numRowsTotal"] == 4 and state["memoryUsedBytes"] < 200_000
        waiting = late.side_rows(spark, side, SCHEMA)
        fates |= {r["fate"] for r in waiting.select("fate").distinct().collect()}
        assert sorted(as_rows(panel.read()) + as_rows(waiting)) == sorted(sent)
    assert fates == {late.LATE, late.REPEATED}
    want = {}
    for rows in deliveries():
        want |= {(e, d): y for e, d, y in rows}
    assert late.merge_side(spark, panel, side) == 5
    assert as_rows(panel.read()) == sorted((*k, y) for k, y in want.items())
    assert late.merge_side(spark, panel, side) == 0


def test_merge_that_stopped_half_way(spark, frame, monkeypatch):
    side = scratch_path(spark, "side")
    panel = KeyedTable(spark, scratch_path(spark, "panel"), SCHEMA, ("entity", "date"))
    for number, y in enumerate((1.0, 2.0)):
        frame([("a", "2024-01-01", y, late.LATE)], FIELDS + ", fate string").write.parquet(f"{side}/batch={number}")
    with monkeypatch.context() as m:
        m.setattr(Folder, "remove", lambda self, name: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            late.merge_side(spark, panel, side)
    assert as_rows(panel.read()) == [("a", "2024-01-01", 2.0)]
    frame([("a", "2024-01-01", 3.0, late.LATE)], FIELDS + ", fate string").write.parquet(f"{side}/batch=2")
    version = panel.version()
    assert late.merge_side(spark, panel, side) == 3 and panel.version() == version + 1
    assert as_rows(panel.read()) == [("a", "2024-01-01", 3.0)]


def test_rows_of_one_batch_and_rows_without_a_date(spark, frame):
    arriving, side = scratch_path(spark, "in"), scratch_path(spark, "side")
    rows = [("a", "2024-03-01", 2.0), ("a", "2024-03-01", 1.0), ("a", "2020-01-01", 5.0), ("a", None, 9.0), (None, "2024-03-01", 4.0)]
    frame(rows, FIELDS).coalesce(1).write.parquet(arriving)
    panel = KeyedTable(spark, scratch_path(spark, "panel"), SCHEMA, ("entity", "date"))
    late.late_sales_sink(spark.readStream.schema(SCHEMA).parquet(arriving), 7, panel, side, scratch_path(spark, "p")).awaitTermination()
    got = sorted((r["entity"] or "", r["target"]) for r in panel.read().collect())
    assert got == [("", 4.0), ("a", 1.0), ("a", 5.0)]  # nothing is late in a first batch
    assert [(r["target"], r["fate"]) for r in late.side_rows(spark, side, SCHEMA).collect()] == [(2.0, late.REPEATED)]
