"""Data-quality checks. Reports are one-row DataFrames; the retail gate raises on the first failed check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.functions.missing import is_numeric

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def schema_problems(
    schema: T.StructType,
    date: str = "date",
    value: str = "target",
    required: Sequence[str] | None = None,
    allow_extra: bool = True,
    allow_zoned: bool = True,
) -> tuple[list[str], list[str]]:
    """(errors, warnings) from the schema alone; runs no job."""
    types = {f.name: f.dataType for f in schema.fields}
    needed = list(required or [date, value])
    errors = [f"Missing required column: {c}" for c in needed if c not in types]
    if errors:
        return errors, []
    warnings = []
    extra = sorted(set(types) - set(needed))
    if extra and not allow_extra:
        warnings.append(f"Unexpected columns (allowed by config): {', '.join(extra)}")
    if date in types and not isinstance(types[date], _DATE_TYPES):
        errors.append(f"Column '{date}' must be datetime-like.")
    if isinstance(types.get(date), T.TimestampType) and not allow_zoned:
        warnings.append("Date column is timezone-aware; downstream may assume UTC or local.")
    if value in types and not is_numeric(types[value]):
        errors.append(f"Column '{value}' must be numeric.")
    return errors, warnings


def validate_schema(df: DataFrame, **rules) -> DataFrame:
    """One row (valid, errors, warnings), with the number of rows the verdict covers."""
    errors, warnings = schema_problems(df.schema, **rules)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(not errors).alias("valid"), _texts(errors).alias("errors"), _texts(warnings).alias("warnings"), "n_rows"
    )


def validate_data(
    df: DataFrame,
    date: str = "date",
    value: str = "target",
    series: str | None = None,
    allow_missing: bool = False,
    min_rows: int = 1,
    max_duplicate_ratio: float = 0.0,
) -> DataFrame:
    """One row: the counts, the duplicate ratio, and the resulting errors.

    Keys are grouped with their row and NULL counts, so one shuffle gives all three figures.
    """
    if series is not None and series not in df.columns:
        errors = _texts([f"series_column '{series}' not in DataFrame."])
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(False).alias("valid"), errors.alias("errors"))
    keys = [date] + ([series] if series else [])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col(value).isNull()).alias("nulls"))
    counted = per_key.agg(
        F.coalesce(F.sum("held"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_unique"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("n_null"),
    ).withColumn("duplicate_ratio", F.when(F.col("n_rows") > 0, 1.0 - F.col("n_unique") / F.col("n_rows")).otherwise(0.0))
    errors = F.array_compact(
        F.array(
            F.when(F.col("n_rows") < min_rows, F.format_string(f"Too few rows: %d < {min_rows}.", "n_rows")),
            F.when(
                (F.col("n_null") > 0) & F.lit(not allow_missing),
                F.format_string(f"Missing values in '{value}': %d.", "n_null"),
            ),
            F.when(
                F.col("duplicate_ratio") > max_duplicate_ratio,
                F.format_string(
                    f"Duplicate (date, series) ratio %.4f exceeds max {max_duplicate_ratio}.", "duplicate_ratio"
                ),
            ),
        )
    )
    return counted.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def retail_report(df: DataFrame, date: str = "date", entity: str = "entity", target: str = "target") -> DataFrame:
    """Everything the retail gate looks at, in one row and one shuffle on (entity, date)."""
    per_key = df.groupBy(entity, date).agg(
        F.count(F.lit(1)).alias("held"),
        F.count_if(F.col(target) < 0).alias("negative"),
        F.min(target).alias("least"),
    )
    return per_key.agg(
        F.coalesce(F.sum("held"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("held") - 1), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("n_negative"),
        F.min("least").alias("min_target"),
        F.count_distinct(F.when(F.col("held") > 1, F.col(entity))).alias("n_not_increasing"),
    )


def duplicate_examples(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = 2
) -> DataFrame:
    """The first rows, in file order, whose key occurs more than once.

    A row beyond the ``limit``-th of its key can never be among the first ``limit`` duplicates, so each
    key is cut to that many rows (at least two, to see the repetition) before the shuffle.
    """
    kept = max(limit, 2)
    by_key = W.partitionBy(*keys)
    rank = F.row_number().over(by_key.orderBy(*order))
    few = df.withColumn("_rank", rank).where(F.col("_rank") <= kept)
    repeated = few.withColumn("_held", F.count(F.lit(1)).over(by_key)).where(F.col("_held") > 1)
    return repeated.drop("_rank", "_held").orderBy(*order).limit(limit)


def monotonic_check(df: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    """Entities whose sorted dates do not strictly increase, that is, with a repeated date."""
    per_day = df.where(F.col(date).isNotNull()).groupBy(entity, date).agg(F.count(F.lit(1)).alias("held"))
    per_entity = per_day.groupBy(entity).agg(F.sum("held").alias("n_rows"), F.count(F.lit(1)).alias("n_dates"))
    return per_entity.where(F.col("n_rows") > F.col("n_dates"))


def validate_retail(
    df: DataFrame,
    date: str = "date",
    entity: str = "entity",
    target: str = "target",
    order: Sequence[str] | None = None,
) -> None:
    """Raise ValueError at the first failed check; schema first, then one job over the data."""
    absent = [c for c in (date, entity, target) if c not in df.columns]
    if absent:
        raise ValueError(f"Missing required columns: {absent}. Found: {df.columns}.")
    types = {f.name: f.dataType for f in df.schema.fields}
    if not isinstance(types[date], _DATE_TYPES):
        raise ValueError(f"Column '{date}' must be datetime. Got type: {types[date].simpleString()}.")
    numeric = is_numeric(types[target])
    checked = df if numeric else df.withColumn(target, F.lit(None).cast("double"))
    found = retail_report(checked, date, entity, target).first()
    if found["n_duplicates"] > 0:
        rows = duplicate_examples(df, [date, entity], list(order or [date, entity]))
        examples = "\n".join(str(r.asDict()) for r in rows.collect())  # two rows
        raise ValueError(
            f"Duplicate (date, {entity}) pairs: {found['n_duplicates']} duplicate row(s). "
            f"Time index must be strictly monotonic per {entity}; "
            f"{found['n_not_increasing']} have repeated dates. Example duplicates:\n{examples}"
        )
    if not numeric:
        raise ValueError(f"Column '{target}' must be numeric. Got type: {types[target].simpleString()}.")
    if found["n_negative"] > 0:
        raise ValueError(
            f"Target must be non-negative. Found {found['n_negative']} negative value(s). "
            f"Min value: {found['min_target']}. Column: '{target}'."
        )
