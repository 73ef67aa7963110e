"""One record per training run, and the check of those records."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.config import FeatureConfig
from tsspark.sources.commits import Versions

_TEXT, _WHOLE, _NUMBER = T.StringType(), T.LongType(), T.DoubleType()
REGISTRY_SCHEMA = (
    T.StructType()
    .add("model_version", _TEXT)
    .add("trained_at", _TEXT)
    .add("training_date_range", T.StructType().add("start", _TEXT).add("end", _TEXT))
    .add("feature_columns", T.ArrayType(_TEXT))
    .add("feature_count", _WHOLE)
    .add("sample_size", _WHOLE)
    .add("hyperparameters", T.MapType(_TEXT, _TEXT))
    .add("residual_std", _NUMBER)
    .add("validation_metrics", T.StructType().add("rmse", _NUMBER).add("mae", _NUMBER).add("mape", _NUMBER))
    .add("feature_importance", T.ArrayType(T.StructType().add("feature", _TEXT).add("importance", _NUMBER)))
    .add("max_lag", _WHOLE)
    .add("lookback_window", _WHOLE)
)


def next_version(registry: DataFrame | None) -> Column:
    """``v`` and the highest number recorded so far plus one."""
    if registry is None:
        return F.lit("v1")
    number = F.regexp_extract("model_version", r"(\d+)$", 1)
    highest = registry.agg(F.max(F.when(number != "", number.cast("bigint")))).scalar()
    return F.concat(F.lit("v"), F.coalesce(highest, F.lit(0)) + 1)


def append_run(record: DataFrame, path: str) -> DataFrame:
    """Append a run record to the Parquet table at ``path`` under the next version, and return it with that version.

    A version is taken by creating its file, which only one of several writers can do; the others take the one after. The
    row is written aside and enters the table as one file. A version whose writer stopped before that stays unused.
    """
    spark = record.sparkSession
    taken = Versions(spark, path, "_versions")  # tables leave out folders with an underscore
    try:
        written = spark.read.schema(REGISTRY_SCHEMA).parquet(path)
        highest = spark.range(1).select(next_version(written)).first()[0]
    except AnalysisException:  # the first run: there is no table yet
        highest = "v1"
    number = max([int(highest.removeprefix("v")), *[n + 1 for n in taken.numbers()]])
    while not taken.commit(number, {"version": f"v{number}"}):
        number += 1
    named = record.withColumn("model_version", F.lit(f"v{number}"))
    aside = f"_staged/{uuid.uuid4().hex}"
    named.coalesce(1).write.parquet(f"{path}/{aside}")
    part = next(n for n in taken.files.names(aside) if n.startswith("part-"))
    taken.files.move(f"{aside}/{part}", f"v{number}.parquet")
    taken.files.remove(aside)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{path}/v{number}.parquet")


def run_record(
    train: DataFrame,
    features: Sequence[str],
    metrics: DataFrame,
    spread: DataFrame,
    target: str = "target",
    date: str = "date",
    config: FeatureConfig = FeatureConfig(),
    hyperparameters: dict[str, object] | None = None,
    importance: DataFrame | None = None,
    registry: DataFrame | None = None,
    trained_at: Column | None = None,
) -> DataFrame:
    """One row in REGISTRY_SCHEMA, ready to be appended to the registry table.

    ``metrics`` and ``spread`` are one-row frames (mae, rmse, mape; residual_std); they enter as scalar
    subqueries. ``importance`` is the short top-k list.
    """
    names = F.array(*[F.lit(f) for f in features]).cast("array<string>")
    lags = F.transform(F.filter(names, lambda n: n.rlike(r"^lag_\d+$")), lambda n: F.substring(n, 5, 18).cast("bigint"))
    max_lag = F.coalesce(F.array_max(lags), F.lit(0).cast("bigint"))
    usable = F.col(target).isNotNull()
    for f in features:
        usable = usable & F.col(f).isNotNull()
    rounded = metrics.select(
        F.struct(F.bround("rmse", 4).alias("rmse"), F.bround("mae", 4).alias("mae"), F.bround("mape", 2).alias("mape"))
    )
    settings = {k: str(v) for k, v in (hyperparameters or {}).items()}
    settings_map = F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]) if settings else F.create_map()
    ranked = F.array()
    if importance is not None:
        listed = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("order"), "feature", "importance")))
        ranked = importance.agg(F.transform(listed, lambda r: F.struct(r["feature"], r["importance"]))).scalar()
    covered = train.agg(
        F.min(date).cast("string").alias("start"),
        F.max(date).cast("string").alias("end"),
        F.count_if(usable).alias("sample_size"),
    )
    record = covered.select(
        next_version(registry).alias("model_version"),
        (trained_at if trained_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("trained_at"),
        F.struct("start", "end").alias("training_date_range"),
        names.alias("feature_columns"),
        F.lit(len(features)).alias("feature_count"),
        "sample_size",
        settings_map.alias("hyperparameters"),
        spread.select("residual_std").scalar().alias("residual_std"),
        rounded.scalar().alias("validation_metrics"),
        ranked.alias("feature_importance"),
        max_lag.alias("max_lag"),
        F.greatest(max_lag, F.lit(max(config.windows, default=0))).alias("lookback_window"),
    )
    return record.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REGISTRY_SCHEMA.fields])


# Fields a record must have, and those that must not be negative.
REQUIRED_FIELDS = tuple(f.name for f in REGISTRY_SCHEMA.fields if f.name != "feature_importance")
NON_NEGATIVE_FIELDS = ("feature_count", "sample_size", "residual_std", "max_lag", "lookback_window")


def registry_check(registry: DataFrame) -> DataFrame:
    """Every record with its list of problems; an empty list is a valid record.

    Absent columns, or ones that cannot be read as the expected type, are an error at once.
    """
    absent = [f for f in REQUIRED_FIELDS if f not in registry.columns]
    if absent:
        raise ValueError(f"Registry is missing fields: {absent}")
    found = [F.when(F.col(f).isNull(), F.lit(f"{f} missing")) for f in REQUIRED_FIELDS]
    found += [F.when(F.col(f) < 0, F.lit(f"{f} negative")) for f in NON_NEGATIVE_FIELDS]
    if "feature_importance" in registry.columns:
        negative = F.exists("feature_importance", lambda i: i["importance"] < 0)
        found.append(F.when(negative, F.lit("importance negative")))
    problems = F.array_compact(F.array(*found))
    return registry.select("*", problems.alias("problems"), (F.size(problems) == 0).alias("valid"))
