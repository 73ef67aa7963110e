from pyspark.sql import functions as F

from tsspark.session import scratch_path
from tsspark.streaming import feeds

PAIRS = "date date, entity string, y_true double, y_pred double"


def deliver(spark, frame, folder, rows):
    frame(rows, PAIRS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame(rows, PAIRS).schema).parquet(folder)


def test_later_batch_wins_and_restart_changes_nothing(spark, frame):
    folder, table, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    stream = deliver(spark, frame, folder, [("2024-01-01", "A", 100.0, 90.0), ("2024-01-02", "A", 100.0, 100.0)])
    feeds.errors_sink(stream, table, progress).awaitTermination()
    stream = deliver(spark, frame, folder, [("2024-01-01", "A", 100.0, 99.0)])
    for _ in range(2):
        feeds.errors_sink(stream, table, progress).awaitTermination()
        got = feeds.current_errors(spark, table).orderBy("date").collect()
        assert [r["abs_error"] for r in got] == [1.0, 0.0]


def test_repeated_batch_overwrites_itself(spark, frame):
    folder, table = scratch_path(spark, "in"), scratch_path(spark, "out")
    stream = deliver(spark, frame, folder, [("2024-01-01", "A", 100.0, 90.0)])
    for _ in range(2):  # progress was lost: batch 0 runs again
        feeds.errors_sink(stream, table, scratch_path(spark, "progress")).awaitTermination()
    assert spark.read.parquet(table).count() == 1


def test_sales_arrive_once(spark):
    folder, table = scratch_path(spark, "csv"), scratch_path(spark, "panel")
    lines = ["entity,date,target", "A,2024-01-01,1", "A,2024-01-01,2", "A,2024-01-02,3", "B,2024-01-01,4", "B,nonsense,5"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    from pyspark.sql import types as T

    schema = T.StructType().add("entity", T.StringType()).add("date", T.DateType()).add("target", T.DoubleType())
    stream = feeds.sales_stream(spark, folder, schema)
    stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(table)
    assert got.count() == 3 and got.select(F.count_distinct("entity", "date")).first()[0] == 3


def test_late_sales_are_kept(spark):
    from pyspark.sql import types as T

    folder, table, progress = (scratch_path(spark, n) for n in ("csv", "panel", "progress"))
    schema = T.StructType().add("entity", T.StringType()).add("date", T.DateType()).add("target", T.DoubleType())
    for lines in (["A,2024-01-01,1", "A,2024-06-01,2"], ["A,2024-01-01,5", "B,2024-01-02,3", "B,2024-01-02,3", "B,nonsense,4"], ["A,2024-06-02,6"]):
        spark.createDataFrame([(x,) for x in ["entity,date,target", *lines]], "value string").coalesce(1).write.mode("append").text(folder)
        feeds.sales_sink(spark, folder, schema, table, progress).awaitTermination()
    got = sorted((r["entity"], str(r["date"]), r["target"]) for r in feeds.current_sales(spark, table, schema).collect())
    assert got == [("A", "2024-01-01", 5.0), ("A", "2024-06-01", 2.0), ("A", "2024-06-02", 6.0), ("B", "2024-01-02", 3.0)]
