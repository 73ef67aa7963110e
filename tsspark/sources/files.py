"""Files in and out: CSV with an explicit schema, Parquet, and fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.functions.missing import nan_to_null

# Columns the store-sales files must have.
SALES_COLUMNS = ("Date", "Store", "Sales", "Open", "Promo", "StateHoliday", "SchoolHoliday")
MASTER_COLUMNS = ("Store", "StoreType", "Assortment", "CompetitionDistance")

SALES_SCHEMA = (
    T.StructType()
    .add("Date", T.DateType())
    .add("Store", T.LongType())
    .add("Sales", T.DoubleType())
    .add("Customers", T.IntegerType())
    .add("Open", T.IntegerType())
    .add("Promo", T.IntegerType())
    .add("StateHoliday", T.StringType())
    .add("SchoolHoliday", T.IntegerType())
)
MASTER_SCHEMA = (
    T.StructType()
    .add("Store", T.LongType())
    .add("StoreType", T.StringType())
    .add("Assortment", T.StringType())
    .add("CompetitionDistance", T.DoubleType())
)


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"{what} missing required columns: {absent}. Found: {df.columns}")


def _header(spark: SparkSession, path: str, encoding: str, options: dict) -> list[str]:
    """Column names as written in the file; reads no data rows."""
    return spark.read.options(header=True, encoding=encoding, inferSchema=False, **options).csv(path).columns


def _csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str, options: dict) -> DataFrame:
    """CSV under the file's own header; columns outside ``schema`` stay text.

    A cell that holds text but no value of its column's type is an error, not a missing value: one aggregate
    counts such cells per column. Adds nothing to the rows.
    """
    types = {f.name: f.dataType for f in schema.fields}
    names = _header(spark, path, encoding, options)
    text = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).options(header=True, encoding=encoding, **options).csv(path)
    typed = {n: types[n] for n in names if n in types and not isinstance(types[n], T.StringType)}
    bad = bad_cells(text, typed)
    if bad:
        raise ValueError(f"Values that cannot be read in {path}: {bad}")
    return nan_to_null(text.withColumns({n: _typed(n, kind) for n, kind in typed.items()}))


def _typed(name: str, kind: T.DataType) -> Column:
    cell = F.trim(F.col(name))
    cell = F.when(F.lower(cell).isin("", "nan"), F.lit(None)).otherwise(cell) if not isinstance(kind, T.StringType) else cell
    if isinstance(kind, T.DateType):
        return cell.try_cast("timestamp_ntz").cast("date")
    return cell.try_cast(kind)


def bad_cells(text: DataFrame, typed: dict[str, T.DataType]) -> dict[str, int]:
    """Per column the number of cells with text that is no value of the column's type; columns without any are left out."""
    if not typed:
        return {}
    present = {n: ~F.lower(F.trim(F.coalesce(F.col(n), F.lit("")))).isin("", "nan") for n in typed}
    counts = text.agg(*[F.count_if(present[n] & _typed(n, kind).isNull()).alias(n) for n, kind in typed.items()]).first()
    return {n: counts[n] for n in typed if counts[n]}


def read_raw_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    date: str = "date",
    parse_dates: bool = True,
    encoding: str = "UTF-8",
    **options: str,
) -> DataFrame:
    """CSV rows as they are; the date column, if present, becomes a date."""
    read_as = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == date else f.dataType) for f in schema.fields]
    )
    df = _csv(spark, path, read_as, encoding, options)
    if parse_dates and date in df.columns:
        df = df.withColumn(date, F.col(date).cast("timestamp_ntz").cast("date"))
    return df


def read_retail_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    date: str = "date",
    entity: str = "entity",
    target: str = "target",
    encoding: str = "UTF-8",
    **options: str,
) -> DataFrame:
    """CSV of one row per (date, entity); runs one aggregate to refuse empty data and bad dates.

    Row order is a matter for the sink: sort there by (date, entity).
    """
    read_as = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == date else f.dataType) for f in schema.fields]
    )
    raw = _csv(spark, path, read_as, encoding, options)
    require_columns(raw, (date, entity, target), "Retail sales CSV")
    parsed = F.col(date).try_cast("timestamp_ntz").cast("date")
    check = raw.agg(F.count(F.lit(1)).alias("n"), F.count_if(parsed.isNull()).alias("bad")).first()
    if check["n"] == 0:
        raise ValueError(f"Retail sales CSV has no rows: {path}")
    if check["bad"] > 0:
        raise ValueError(f"Date column '{date}' has {check['bad']} unparseable value(s) in {path}")
    return raw.withColumn(date, parsed)


def read_sales(spark: SparkSession, path: str, schema: T.StructType = SALES_SCHEMA) -> DataFrame:
    df = _csv(spark, path, schema, "UTF-8", {})
    require_columns(df, SALES_COLUMNS, "sales CSV")
    return df


def read_store_master(spark: SparkSession, path: str, schema: T.StructType = MASTER_SCHEMA) -> DataFrame:
    df = _csv(spark, path, schema, "UTF-8", {})
    require_columns(df, MASTER_COLUMNS, "store CSV")
    return df


def read_processed(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Processed panel; with ``columns`` only those reach the Parquet scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_processed(df: DataFrame, path: str, entity: str = "entity", date: str = "date") -> bool:
    """Parquet clustered by (entity, date), so row-group statistics prune a filter on the entity.

    Range partitions cut through an entity where it is large, and there is no folder per entity.
    Nothing is written, and False returned, if there is no row. The rows are kept while they are counted, sampled for the
    ranges and written, so what leads to them is computed once.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if df.isEmpty():
            return False
        clustered = df.repartitionByRange(F.col(entity), F.col(date)).sortWithinPartitions(entity, date)
        clustered.write.mode("overwrite").parquet(path)
        return True
    finally:
        df.unpersist()


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV if the path ends in ``.csv``, else Parquet."""
    if path.lower().endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PipelineModel, metadata: DataFrame, path: str) -> None:
    """Fitted stages, and the one-row run record beside them."""
    model.write().overwrite().save(f"{path}/model")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str, schema: T.StructType) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.schema(schema).json(f"{path}/metadata")


def etl_summary(df: DataFrame, date: str = "date", entity: str | None = "entity") -> DataFrame:
    """Row count, first and last date, and the number of entities, in one pass."""
    measures = [F.count(F.lit(1)).alias("rows")]
    if date in df.columns:
        measures += [F.min(date).alias("date_min"), F.max(date).alias("date_max")]
    if entity and entity in df.columns:
        measures.append(F.count_distinct(entity).alias("entities"))
    return df.agg(*measures)
