"""Registered queries: streaming forms, run over the whole tables as finished streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.plans.catalog import SEGMENTS, query, with_
from tsspark.plans.catalog_etl import SHOW_SEGMENTS, TEXT_PANEL
from tsspark.plans.catalog_evaluation import PAIRS, POINTS, sales_pairs
from tsspark.session import scratch_path
from tsspark.sources import files, panels
from tsspark.streaming import feeds


@query("stream_errors", with_(*PAIRS, POINTS, "SELECT entity, CAST(date AS VARCHAR) AS date, abs_error, ape FROM points"), digits=8)
def stream_errors(spark, sf_dir):
    """A first delivery with wrong forecasts, then the right ones: the later batch wins."""
    arriving, table, checkpoint = (scratch_path(spark, n) for n in ("pairs", "errors", "progress"))
    pairs = sales_pairs(spark, sf_dir)
    for delivery in (pairs.withColumn("y_pred", F.col("y_pred") + 100), pairs):
        delivery.write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(pairs.schema).parquet(arriving)
        feeds.errors_sink(stream, table, checkpoint).awaitTermination()
    return feeds.current_errors(spark, table)


@query("stream_sales", with_(SEGMENTS, SHOW_SEGMENTS))
def stream_sales(spark, sf_dir):
    """Late rows and corrections: a first delivery lacks every third day and has wrong values, a second one has all days."""
    arriving, table, checkpoint = (scratch_path(spark, n) for n in ("sales", "panel", "progress"))
    panel = panels.segment_daily(spark, sf_dir)
    early = panel.where(F.dayofyear("date") % 3 != 0).withColumn("target", F.col("target") + 1)
    for number, delivery in enumerate((early, panel.unionByName(panel))):
        files.export_csv(delivery, f"{arriving}/{number}")
        names = spark.read.option("header", True).csv(f"{arriving}/{number}").columns
        ordered = T.StructType([TEXT_PANEL[n] for n in names])
        feeds.sales_sink(spark, f"{arriving}/*", ordered, table, checkpoint).awaitTermination()
    return feeds.current_sales(spark, table, TEXT_PANEL)
