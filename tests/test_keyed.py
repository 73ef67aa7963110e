import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.session import scratch_path
from tsspark.sources.commits import Folder, Versions
from tsspark.sources.keyed import KeyedTable, newest
from tsspark.streaming import feeds

SCHEMA = T.StructType().add("entity", T.StringType()).add("date", T.DateType()).add("value", T.DoubleType()).add("age", T.LongType())
FIELDS = "entity string, date date, value double, age long"


@pytest.fixture
def table(spark):
    return lambda **layout: KeyedTable(spark, scratch_path(spark, "keyed"), SCHEMA, ("entity", "date"), **layout)


def rows_of(df):
    return sorted(tuple(r[c] for c in SCHEMA.names) for r in df.collect())


def files_of(spark, table, suffix=".parquet"):
    folder = Folder(spark, table.path)
    return [f"{d}/{b}/{f}" for d in folder.names("data") for b in folder.names(f"data/{d}") if b.startswith("bucket") for f in folder.names(f"data/{d}/{b}") if f.endswith(suffix)]


def test_newest_row_per_key(frame, table):
    t, merge = table(bucket_days=10), newest(("entity", "date"), ("age",))
    assert t.read().count() == 0 and t.version() == 0
    t.upsert(frame([("a", "2024-01-01", 1.0, 5), ("a", "2024-01-01", 2.0, 7), ("b", "2024-03-01", 3.0, 1)], FIELDS), merge)
    t.upsert(frame([("a", "2024-01-01", 9.0, 6), ("b", "2024-03-01", 4.0, 1), ("c", "1969-12-31", 5.0, 0)], FIELDS), merge)
    assert rows_of(t.read()) == [("a", date(2024, 1, 1), 2.0, 7), ("b", date(2024, 3, 1), 4.0, 1), ("c", date(1969, 12, 31), 5.0, 0)]
    assert t.version() == 2
    with pytest.raises(ValueError, match="date"):
        t.upsert(frame([("a", None, 1.0, 1)], FIELDS), merge)
    with pytest.raises(ValueError, match="keys"):
        KeyedTable(t._spark, t.path, SCHEMA, ("entity",))


def test_a_batch_rewrites_its_buckets_only(spark, frame, table):
    t, merge = table(bucket_days=31), newest(("entity", "date"), ())
    t.upsert(frame([("a", f"2024-{m:02d}-15", 1.0, 0) for m in range(1, 13)], FIELDS), merge)
    before = set(files_of(spark, t))
    t.upsert(frame([("b", "2024-06-15", 2.0, 0)], FIELDS), merge)
    added = set(files_of(spark, t)) - before
    assert len(added) == 1 and before <= set(files_of(spark, t))
    june = t.read(date(2024, 6, 1), date(2024, 6, 30))
    assert len(june.inputFiles()) <= 2 and rows_of(june) == [("a", date(2024, 6, 15), 1.0, 0), ("b", date(2024, 6, 15), 2.0, 0)]


def test_many_batches_leave_few_files(spark, frame, table):
    rng, t, merge, want = random.Random(1), table(bucket_days=31, files=2), newest(("entity", "date"), ("age",)), {}
    for number in range(40):
        batch = {(rng.choice("abcdef"), f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d}"): float(number) for _ in range(5)}
        t.upsert(frame([(*k, v, number) for k, v in batch.items()], FIELDS).coalesce(1), merge, ("stream", number))
        want |= {k: (v, number) for k, v in batch.items()}
    assert rows_of(t.read()) == sorted((e, date.fromisoformat(d), *v) for (e, d), v in want.items())
    buckets = len({r[0] for r in t.read().select(t._bucket()).distinct().collect()})
    assert len(files_of(spark, t)) <= buckets * 2 * 2 and len(t._versions.numbers()) == 2
    assert len(Folder(spark, t.path).names("data")) <= 2 * buckets + 1 and t.last_batch("stream") == 39


class Stopped(Exception):
    pass


@pytest.mark.parametrize("where", ["before write", "before commit", "after commit", "inside clean"])
def test_restart_at_every_point_keeps_the_table(spark, frame, table, monkeypatch, where):
    t, merge = table(bucket_days=5), newest(("entity", "date"), ("age",))
    batches = [[("a", f"2024-01-{d:02d}", float(n), n) for d in range(n + 1, n + 6)] for n in range(4)]
    for number, rows in enumerate(batches):
        with monkeypatch.context() as m:
            def stop(*_, **__):
                raise Stopped

            original = Folder.remove
            targets = {"before write": (KeyedTable, "_write", stop), "before commit": (Versions, "commit", stop), "after commit": (KeyedTable, "clean", stop)}
            owner, name, act = targets.get(where, (Folder, "remove", lambda self, n: stop() if n.startswith("data/") else original(self, n)))
            m.setattr(owner, name, act)
            try:
                t.upsert(frame(rows, FIELDS), merge, ("s", number))
            except Stopped:
                pass
        t.upsert(frame(rows, FIELDS), merge, ("s", number))  # the stream starts again with the same batch
        want = {}
        for done in batches[: number + 1]:
            want |= {(e, d): (e, date.fromisoformat(d), v, a) for e, d, v, a in done}
        assert rows_of(t.read()) == sorted(want.values())
        assert t.version() == number + 1
    t.clean()
    t.clean()
    assert rows_of(t.read()) == sorted(want.values())
    named = {f for n in t._versions.numbers() for f in t._versions.read(n)["buckets"].values()}
    left = {f for f in Folder(spark, t.path).names("data")}
    assert named <= left and all(int(f.split("-")[0]) >= t._versions.numbers()[0] for f in left - named)


def test_an_old_batch_does_not_come_back_but_another_stream_may(frame, table):
    t, merge = table(), newest(("entity", "date"), ())
    first, second = (frame([("a", "2024-01-01", v, 0)], FIELDS) for v in (1.0, 2.0))
    t.upsert(first, merge, ("s", 0))
    t.upsert(second, merge, ("s", 1))
    assert t.upsert(first, merge, ("s", 0)) == 2 and [r[2] for r in rows_of(t.read())] == [2.0]
    t.upsert(first, merge, ("other", 0))
    assert [r[2] for r in rows_of(t.read())] == [1.0]


def test_writers_at_once_lose_nothing(frame, table):
    t, merge = table(bucket_days=1000, keep=20), newest(("entity", "date"), ())
    batches = [frame([(f"e{k}", "2024-01-01", float(k), 0)], FIELDS).coalesce(1) for k in range(5)]
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda b: t.upsert(b, merge), batches))
    assert [r[0] for r in rows_of(t.read())] == [f"e{k}" for k in range(5)] and t.version() == 5


def test_a_file_is_created_once(spark):
    folder = Folder(spark, scratch_path(spark, "files"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: folder.create("sub/name.json", f"text {k} é"), range(16)))
    assert sum(won) == 1 and folder.read("sub/name.json") == f"text {won.index(True)} é"
    assert folder.names("_drafts") == [] and folder.names("nothing") == [] and not folder.exists("other")


def test_error_points_arrive_out_of_order(spark, frame):
    fields = "entity string, date date, y_true double, y_pred double, at long"
    t = feeds.errors_table(spark, scratch_path(spark, "errors"), bucket_days=2)
    arriving, progress = scratch_path(spark, "in"), scratch_path(spark, "progress")
    deliveries = [
        [("a", "2024-01-01", 100.0, 90.0, 5), ("a", "2024-01-01", 100.0, 80.0, 4), ("a", "2024-01-02", 10.0, 10.0, 1)],
        [("a", "2024-01-01", 100.0, 1.0, 2), ("a", "2024-01-02", 10.0, 12.0, 3), ("b", "2024-01-05", 0.0, float("nan"), 3), ("b", None, 1.0, 1.0, 1)],
    ]
    for rows in deliveries:
        frame(rows, fields).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(frame(rows, fields).schema).parquet(arriving)
        for _ in range(2):
            feeds.errors_table_sink(stream, t, progress, "at").awaitTermination()
    got = sorted((r["entity"], str(r["date"]), r["abs_error"], r["age"]) for r in t.read().collect())
    assert got == [("a", "2024-01-01", 10.0, 5.0), ("a", "2024-01-02", 2.0, 3.0)]


def test_sales_arrive_late_and_corrected(spark):
    schema = T.StructType().add("entity", T.StringType()).add("date", T.DateType()).add("target", T.DoubleType())
    folder, progress = scratch_path(spark, "csv"), scratch_path(spark, "progress")
    t = KeyedTable(spark, scratch_path(spark, "sales"), schema, ("entity", "date"))
    for lines in (["A,2024-01-01,1", "A,2024-06-01,2"], ["A,2024-01-01,5", "B,2024-01-02,3", "B,2024-01-02,3", "B,nonsense,4"], ["A,2024-06-02,6"]):
        spark.createDataFrame([(x,) for x in ["entity,date,target", *lines]], "value string").coalesce(1).write.mode("append").text(folder)
        feeds.sales_table_sink(spark, folder, t, progress).awaitTermination()
    got = sorted((r["entity"], str(r["date"]), r["target"]) for r in t.read().collect())
    assert got == [("A", "2024-01-01", 5.0), ("A", "2024-06-01", 2.0), ("A", "2024-06-02", 6.0), ("B", "2024-01-02", 3.0)]
    assert t.read().select(F.count_distinct("entity", "date")).first()[0] == 4
