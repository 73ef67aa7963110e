"""Store-sales cleaning: daily sales joined to a store master, under one enforced output schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.operators.clean import clean_dates, keep_first
from tsspark.operators.ordered import exact_quantiles
from tsspark.operators.sketches import daily_sketches, sketch_quantiles
from tsspark.operators.validate import monotonic_check
from tsspark.sources.files import MASTER_COLUMNS, SALES_COLUMNS, require_columns

# Input names and the names used from here on.
RENAMES = {
    "Date": "date",
    "Store": "store_id",
    "Sales": "target_raw",
    "Open": "open",
    "Promo": "promo",
    "StateHoliday": "state_holiday",
    "SchoolHoliday": "school_holiday",
    "StoreType": "store_type",
    "Assortment": "assortment",
    "CompetitionDistance": "competition_distance",
}
FLAGS = ("open", "promo", "school_holiday")
# Output types.
OUTPUT_TYPES = {
    "store_id": "bigint",
    "open": "bigint",
    "promo": "bigint",
    "target_raw": "double",
    "target_cleaned": "double",
    "state_holiday": "string",
}
CLEAN_INPUT = (
    "date", "store_id", "target_cleaned", "open", "promo",
    "school_holiday", "competition_distance", "state_holiday", "store_type", "assortment",
)


def merge_store(sales: DataFrame, master: DataFrame, key: str = "Store", suffix: str = "_store") -> DataFrame:
    """All sales rows with the attributes of their store, where known.

    The master has one row per store and grows with the number of stores, so nothing is forced to be
    broadcast: Spark does it below its size threshold and splits skewed stores above it.
    """
    for side, name in ((sales, "sales"), (master, "store master")):
        require_columns(side, (key,), name)
    clashes = {c: c + suffix for c in master.columns if c != key and c in sales.columns}
    return sales.join(master.withColumnsRenamed(clashes), key, "left")


def normalize_schema(df: DataFrame) -> DataFrame:
    """Internal names; the target as double with a copy to clean; flags as booleans, missing = true."""
    require_columns(df, tuple(dict.fromkeys(SALES_COLUMNS + MASTER_COLUMNS)), "store sales")
    renamed = df.withColumnsRenamed(RENAMES).withColumns(
        {"date": F.col("date").cast("date"), "target_raw": F.col("target_raw").cast("double")}
    )
    flags = {f: F.coalesce(F.col(f).cast("boolean"), F.lit(True)) for f in FLAGS}
    return renamed.withColumns({"target_cleaned": F.col("target_raw"), **flags})


def zero_closed_days(df: DataFrame) -> DataFrame:
    """A closed day sold nothing; its row stays."""
    is_open = F.coalesce(F.col("open").cast("boolean"), F.lit(True))
    return df.withColumn("target_cleaned", F.when(is_open, F.col("target_cleaned")).otherwise(0.0))


def drop_missing_keys(df: DataFrame, keys: Sequence[str] = ("date", "store_id")) -> DataFrame:
    return df.dropna(subset=list(keys))


def median_fill(
    df: DataFrame, column: str = "competition_distance", median: Column | None = None, approximate: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    """Missing values become the median over all rows, or 0 if there is no value at all.

    The exact median runs a job while the plan is built; ``approximate`` takes it from a sketch, or from ``sketches`` of days.
    """
    if median is None and (approximate or sketches is not None):
        median = sketch_quantiles(daily_sketches(df, column, None) if sketches is None else sketches, (0.5,)).scalar()[0]
    elif median is None:
        median = exact_quantiles(df, column, (0.5,)).scalar()[0]
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), median, F.lit(0.0)))


def enforce_output_schema(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(OUTPUT_TYPES[c]).alias(c) if c in OUTPUT_TYPES else F.col(c) for c in df.columns])


def clean_store_sales(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cleaning of already merged and normalised rows; ``order`` is the file order."""
    require_columns(df, CLEAN_INPUT, "store sales")
    out = drop_missing_keys(zero_closed_days(clean_dates(df)))
    out = keep_first(median_fill(out), ("store_id", "date"), order)
    return enforce_output_schema(out)


def store_sales(sales: DataFrame, master: DataFrame, order: Sequence[str]) -> DataFrame:
    """Load, merge, normalise and clean in one plan, arranged for size.

    Same rows as merging first: the master adds attributes only, so the repeated (store, day) rows are
    dropped before the join, and the row-weighted median comes from row counts per store.
    """
    require_columns(sales, SALES_COLUMNS, "sales")
    require_columns(master, MASTER_COLUMNS, "store master")
    kept = sales.withColumn("Date", F.col("Date").cast("date")).dropna(subset=["Date", "Store"])
    per_store = kept.groupBy("Store").agg(F.count(F.lit(1)).alias("rows"))
    weighted = per_store.join(master.select("Store", "CompetitionDistance"), "Store")
    median = exact_quantiles(weighted, "CompetitionDistance", (0.5,), weight="rows").scalar()[0]
    merged = merge_store(keep_first(kept, ("Store", "Date"), order), master)
    return enforce_output_schema(median_fill(zero_closed_days(normalize_schema(merged)), median=median))


def assert_increasing(df: DataFrame, entity: str = "store_id", date: str = "date") -> None:
    """Raise if an entity repeats a date; one aggregate job."""
    offender = monotonic_check(df, entity, date).first()
    if offender is not None:
        raise AssertionError(f"Dates are not strictly increasing for {entity}={offender[entity]}")
