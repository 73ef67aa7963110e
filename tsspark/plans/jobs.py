"""Batch jobs for spark-submit, from files to files.

    spark-submit tsspark/plans/jobs.py clean --mode retail --input raw.csv --output processed
    spark-submit tsspark/plans/jobs.py train --input processed --model model [--registry runs]
    spark-submit tsspark/plans/jobs.py forecast --input processed --model model --output forecast.csv
    spark-submit tsspark/plans/jobs.py backtest --input processed --output backtest [--model model]

Panels have the columns entity, date and target unless a settings file (JSON) says otherwise. Entities that a
forecast or backtest leaves out are listed, with the reason, in a table beside the output (``<output>-rejects``).
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.config import Settings, overlay
from tsspark.operators.augment import MissingBlocks, NoiseShift, TrendChange, augment_timeseries
from tsspark.operators.backtest import backtest_naive
from tsspark.operators.clean import ClipRule
from tsspark.operators.features import split_stages, stage_config, with_stages
from tsspark.operators.forecast import check_bounds, history_guard, known_entities
from tsspark.operators.registry import REGISTRY_SCHEMA, append_run
from tsspark.operators.trees import backtest_trees
from tsspark.plans import etl, training
from tsspark.sources import files


def _panel_schema(settings: Settings) -> T.StructType:
    names = settings.columns
    return T.StructType().add(names.entity, T.StringType()).add(names.date, T.DateType()).add(names.target, T.DoubleType())


def _file_order() -> Column:
    """The order of rows in the files, files by name; Spark reads splits in another order."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def _augmentation(settings: Settings, value: str) -> etl.Augment | None:
    rules, names = settings.clean, settings.columns
    if not rules.augment:
        return None
    kinds = {
        "missing": MissingBlocks() if rules.missing_blocks else None,
        "noise": NoiseShift() if rules.noise_shift else None,
        "trend": TrendChange() if rules.trend_change else None,
    }
    return lambda df: augment_timeseries(df, rules.seed, names.entity, names.date, value, **kinds)


def _asked(panel: DataFrame, args: argparse.Namespace, entity: str) -> tuple[DataFrame, DataFrame]:
    """The panel of the requested ids, all without a request, and a table (entity, reason) of unknown ones."""
    spark, kind = panel.sparkSession, panel.schema[entity].dataType
    ids = sorted(set(args.ids.split(","))) if args.ids else []
    requested = spark.createDataFrame([(i,) for i in ids], "id string").select(F.col("id").try_cast(kind).alias(entity), "id")
    known = known_entities(requested, panel, entity)
    unknown = known.where(~F.col("known")).select(F.col("id").alias("entity"), F.lit("unknown_id").alias("reason"))
    if not ids:
        return panel, unknown
    return panel.join(known.where("known").select(entity), entity, "left_semi"), unknown


def _short(status: DataFrame, entity: str) -> DataFrame:
    return status.where(F.col("status") != "ok").select(F.col(entity).cast("string").alias("entity"), F.col("status").alias("reason"))


def clean_job(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> DataFrame:
    names, schema, rules = settings.columns, _panel_schema(settings), settings.clean
    if args.mode == "store":
        numbered = files.read_sales(spark, args.input).withColumn("row_order", _file_order())
        out = etl.run_store_sales(numbered, files.read_store_master(spark, args.stores), ["row_order"]).drop("row_order")
        keys = {"entity": "store_id", "date": "date"}
    elif args.mode == "retail":
        raw = files.read_retail_csv(spark, args.input, schema, names.date, names.entity, names.target)
        cleaning = {"date": names.date, "entity": names.entity, "target": names.target, "span": rules.span, "strategy": rules.strategy}
        if rules.clip_by_quartiles or rules.clip_lower is not None or rules.clip_upper is not None:
            cleaning["clip"] = ClipRule(rules.clip_lower, rules.clip_upper, rules.clip_by_quartiles)
        out = etl.run_retail(raw, cleaning, _augmentation(settings, "target_cleaned"), check=not args.no_validate)
        keys = {"entity": names.entity, "date": names.date}
    else:
        raw = files.read_raw_csv(spark, args.input, schema, names.date)
        checks = {"date": names.date, "value": names.target}
        cleaning = checks | {"timezone": rules.timezone, "lower": rules.clip_lower, "upper": rules.clip_upper}
        if rules.deduplicate:
            raw = raw.withColumn("row_order", _file_order())
            cleaning |= {"unique_by": [names.entity, names.date], "order": ["row_order"]}
        out = etl.run_generic(raw, checks, cleaning, _augmentation(settings, names.target), check=not args.no_validate).drop("row_order")
        keys = {"entity": names.entity, "date": names.date}
    if files.write_processed(out, args.output, **keys):
        out = files.read_processed(spark, args.output)  # the summary of what was written, without cleaning again
    return files.etl_summary(out, keys["date"], keys["entity"])


def train_job(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> DataFrame:
    run = training.train_and_compare(files.read_processed(spark, args.input), settings)
    record = append_run(run.record, args.registry) if args.registry else run.record
    files.save_model(with_stages(run.stages, run.model), record, args.model)
    return run.comparison


def _saved_model(spark: SparkSession, path: str, settings: Settings) -> tuple[PipelineModel, DataFrame, Settings]:
    """The scoring part of a saved pipeline, its run record, and settings with the features it was trained on."""
    pipeline, record = files.load_model(spark, path, REGISTRY_SCHEMA)
    stages, model = split_stages(pipeline)
    return model, record, replace(settings, features=stage_config(stages, settings.features))


def forecast_job(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> DataFrame:
    horizon = args.horizon or settings.forecast.horizon
    check_bounds(horizon, max_horizon=settings.forecast.max_horizon)
    names = settings.columns
    model, record, settings = _saved_model(spark, args.model, settings)
    run = record.select("residual_std", "max_lag").first()
    panel, unknown = _asked(files.read_processed(spark, args.input), args, names.entity)
    status = history_guard(panel, run["max_lag"], settings.forecast.min_history, names.entity)
    unknown.unionByName(_short(status, names.entity)).write.mode("overwrite").parquet(f"{args.output}-rejects")
    ready = panel.join(status.where(F.col("status") == "ok").select(names.entity), names.entity, "left_semi")
    made = training.batch_forecast(ready, model, settings, run["residual_std"], horizon)
    files.write_predictions(made, args.output)
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("entities"))


def backtest_job(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> DataFrame:
    horizon = args.horizon or settings.forecast.seasonality
    check_bounds(horizon, args.splits, settings.forecast.max_horizon, settings.forecast.max_splits)
    names = settings.columns
    columns = {"entity": names.entity, "date": names.date, "target": names.target}
    panel, unknown = _asked(files.read_processed(spark, args.input), args, names.entity)
    if args.model:
        model, _, settings = _saved_model(spark, args.model, settings)
    max_lag = max(settings.features.lags, default=0) if args.model else 0
    status = history_guard(panel, max(max_lag, settings.forecast.min_history) + horizon, 0, names.entity)
    unknown.unionByName(_short(status, names.entity)).write.mode("overwrite").parquet(f"{args.output}-rejects")
    panel = panel.join(status.where(F.col("status") == "ok").select(names.entity), names.entity, "left_semi")
    if args.model:
        splits = backtest_trees(panel, model, horizon, args.splits, config=settings.features, **columns)
    else:
        splits = backtest_naive(panel, horizon, args.splits, settings.forecast.seasonality, **columns)
    splits.write.mode("overwrite").parquet(args.output)
    return spark.read.parquet(args.output).agg(F.count(F.lit(1)).alias("splits"), F.avg("mae").alias("mae"))


JOBS = {"clean": clean_job, "train": train_job, "forecast": forecast_job, "backtest": backtest_job}


def parse(argv: Sequence[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--input", required=True)
    parser.add_argument("--output")
    parser.add_argument("--settings", help="JSON file with changes to the default settings")
    parser.add_argument("--mode", choices=("generic", "retail", "store"), default="generic")
    parser.add_argument("--stores", help="store master CSV, for --mode store")
    parser.add_argument("--no-validate", action="store_true")
    parser.add_argument("--model")
    parser.add_argument("--registry", help="Parquet table of run records to append to")
    parser.add_argument("--ids", help="comma-separated entities to forecast or backtest; all without it")
    parser.add_argument("--horizon", type=int)
    parser.add_argument("--splits", type=int, default=3)
    return parser.parse_args(argv)


def main(argv: Sequence[str], spark: SparkSession | None = None) -> DataFrame:
    args = parse(argv)
    settings = Settings()
    if args.settings:
        with open(args.settings, encoding="utf-8") as handle:
            settings = overlay(settings, json.load(handle))
    session = spark or SparkSession.builder.appName(f"tsspark {args.job}").getOrCreate()
    report = JOBS[args.job](session, args, settings)
    report.show(truncate=False)
    return report


if __name__ == "__main__":
    main(sys.argv[1:])
