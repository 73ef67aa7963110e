"""Canonical panels: one row per (entity, day), derived from the warehouse tables.

Each panel is a grouped sum or count, so Spark combines rows before the shuffle and one very busy entity
costs one row per day and task. After that an entity has at most as many rows as the calendar has days,
which is the bound every per-entity window in this package relies on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units shipped per supplier and day; sparse, so it has calendar gaps."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(F.sum("l_quantity").alias("target"))


def segment_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per market segment and day.

    Orders are counted per (customer, day) first, so the join moves grouped rows only.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customers, "c_custkey")
        .groupBy(F.col("c_mktsegment").alias("entity"), "date")
        .agg(F.sum("n").cast("double").alias("target"))
    )


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day; dense."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("entity"), F.col("ts").cast("date").alias("date"))
        .agg(F.count(F.lit(1)).cast("double").alias("target"))
    )


def store_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier attributes under the store-sales input names; a negative balance counts as unknown."""
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("Store"),
            F.col("n_name").alias("StoreType"),
            F.col("n_regionkey").cast("string").alias("Assortment"),
            F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("CompetitionDistance"),
        )
    )


def raw_store_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under the store-sales input names, with repeated (store, day) keys.

    ``l_orderkey, l_linenumber`` is the file order that "keep the first" refers to.
    """
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        day.alias("Date"),
        F.col("l_suppkey").alias("Store"),
        F.col("l_quantity").alias("Sales"),
        F.when(F.weekday(day) == 6, 0).otherwise(1).alias("Open"),
        F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("Promo"),
        F.col("l_returnflag").alias("StateHoliday"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("SchoolHoliday"),
        "l_orderkey",
        "l_linenumber",
    )


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw (entity, date, target) rows with duplicates and a file order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("target"),
        "l_orderkey",
        "l_linenumber",
    )


def forecast_pairs(panel: DataFrame, season: int = 7) -> DataFrame:
    """(entity, date, y_true, y_pred) with the value ``season`` rows earlier as the forecast."""
    earlier = F.lag("target", season).over(W.partitionBy("entity").orderBy("date"))
    return panel.select("entity", "date", F.col("target").alias("y_true"), earlier.alias("y_pred")).where(
        F.col("y_pred").isNotNull()
    )
