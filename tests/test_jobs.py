import json
import math

import pytest
from pyspark.sql import functions as F

from tsspark.operators.forecast import seasonal_naive
from tsspark.plans import jobs
from tsspark.session import scratch_path


@pytest.fixture
def raw(spark, days):
    path = scratch_path(spark, "raw")
    lines = ["entity,date,target"] + [
        f"{e},{d},{50 + 10 * math.sin(i) + i % 7:.3f}" for e in "AB" for i, d in enumerate(days("2024-01-01", 50)) if i % 10 != 4
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_from_raw_file_to_forecast_and_backtest(spark, raw, tmp_path):
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({"columns": {"target": "target_cleaned"}, "trees": {"n_trees": 3, "max_depth": 2}}))
    processed, model, registry, out = (scratch_path(spark, n) for n in ("processed", "model", "registry", "out"))
    summary = jobs.main(["clean", "--mode", "retail", "--input", raw, "--output", processed], spark).first()
    assert (summary["rows"], summary["entities"]) == (100, 2)
    panel = spark.read.parquet(processed)
    assert panel.where("target_cleaned is null").isEmpty() and panel.where("target is null").count() == 10

    common = ["--input", processed, "--settings", str(settings)]
    for _ in range(2):
        roles = jobs.main(["train", *common, "--model", model, "--registry", registry], spark).collect()
        assert {r["role"] for r in roles} == {"baseline", "primary"}
    runs = spark.read.parquet(registry)
    assert sorted(r["model_version"] for r in runs.collect()) == ["v1", "v2"]

    jobs.main(["forecast", *common, "--model", model, "--output", out + ".csv", "--horizon", "4"], spark)
    made = spark.read.option("header", True).csv(out + ".csv")
    assert made.count() == 8 and made.where("confidence_low is null").isEmpty()

    jobs.main(["forecast", *common, "--model", model, "--output", out + "2.csv", "--horizon", "4", "--ids", "A,Z"], spark)
    made = spark.read.option("header", True).csv(out + "2.csv")
    assert {r["entity_id"] for r in made.select("entity_id").collect()} == {"A"}
    rejects = spark.read.parquet(out + "2.csv-rejects").collect()
    assert [(r["entity"], r["reason"]) for r in rejects] == [("Z", "unknown_id")]

    for extra in ([], ["--model", model]):
        report = jobs.main(["backtest", *common, *extra, "--output", scratch_path(spark, "splits"), "--horizon", "5"], spark).first()
        assert report["splits"] == 6 and report["mae"] >= 0


def test_bounds_are_checked(spark, raw):
    with pytest.raises(ValueError, match="horizon"):
        jobs.main(["backtest", "--input", raw, "--output", "unused", "--horizon", "99"], spark)


def test_other_step_length(frame, days):
    df = frame([(d, "A", float(i)) for i, d in enumerate(days("2024-01-01", 7))], "date date, entity string, target double")
    out = seasonal_naive(df, 2, step_days=7).orderBy("step").collect()
    assert [str(r["date"]) for r in out] == ["2024-01-14", "2024-01-21"]


def test_cleaning_options(spark, raw, tmp_path):
    settings = tmp_path / "clean.json"
    settings.write_text(json.dumps({"clean": {"clip_upper": 52.0, "augment": True, "deduplicate": True}, "monitor": {"mape_alert": 0.2}}))
    out = scratch_path(spark, "processed")
    jobs.main(["clean", "--mode", "retail", "--input", raw, "--output", out, "--settings", str(settings)], spark)
    panel = spark.read.parquet(out)
    assert "augmentation_type" in panel.columns and panel.where("target_original > 52").isEmpty()
    doubled = scratch_path(spark, "raw")
    spark.read.text(raw).unionAll(spark.read.text(raw).where("value not like 'entity%'")).coalesce(1).write.text(doubled)
    jobs.main(["clean", "--mode", "generic", "--input", doubled, "--output", out + "2", "--settings", str(settings), "--no-validate"], spark)
    assert spark.read.parquet(out + "2").count() == 90


def test_percent_settings_and_bad_cells(spark, tmp_path):
    from tsspark.config import Settings, overlay

    assert overlay(Settings(), {"monitor": {"mape_alert": 0.2}}).monitor.mape_alert == 20.0
    assert overlay(Settings(), {"monitor": {"mape_alert": 15}}).monitor.mape_alert == 15
    path = scratch_path(spark, "bad")
    spark.createDataFrame([("entity,date,target",), ("A,2024-01-01,abc",), ("A,2024-01-02,",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(ValueError, match="target"):
        jobs.main(["clean", "--mode", "retail", "--input", path, "--output", "unused"], spark)


def test_forecasts_replay_the_features_of_the_training_run(spark, raw, tmp_path):
    """Other feature settings at forecast time change nothing: the saved pipeline knows its own."""
    from tsspark.operators.features import add_features, split_stages, stage_config
    from tsspark.config import FeatureConfig
    from tsspark.operators.registry import REGISTRY_SCHEMA
    from tsspark.sources import files

    def settings(name, features):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({"columns": {"target": "target_cleaned"}, "trees": {"n_trees": 2, "max_depth": 2}, "features": features}))
        return ["--settings", str(path)]

    processed, model, out = (scratch_path(spark, n) for n in ("processed", "model", "out"))
    trained, other = settings("a", {"lags": [1, 3], "windows": [4], "min_periods": 2}), settings("b", {"lags": [2], "windows": [9]})
    jobs.main(["clean", "--mode", "retail", "--input", raw, "--output", processed], spark)
    jobs.main(["train", "--input", processed, "--model", model, *trained], spark)
    made = []
    for k, asked in enumerate((trained, other)):
        jobs.main(["forecast", "--input", processed, "--model", model, "--output", f"{out}{k}", "--horizon", "6", *asked], spark)
        made.append(sorted(spark.read.parquet(f"{out}{k}").collect()))
    assert made[0] == made[1] and len(made[0]) == 12

    pipeline, _ = files.load_model(spark.newSession(), model, REGISTRY_SCHEMA)
    stages, scoring = split_stages(pipeline)
    config = stage_config(stages)
    assert config == FeatureConfig((1, 3), (4,), 2)
    panel = spark.read.parquet(processed)
    want = add_features(panel, "target_cleaned", config=config)
    assert sorted(stages.transform(panel).select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    assert pipeline.transform(panel.dropna()).where("prediction is null").isEmpty()
    assert stage_config(split_stages(scoring)[0]) == FeatureConfig()


def test_runs_at_once_get_a_version_each(spark):
    from concurrent.futures import ThreadPoolExecutor

    from tsspark.operators import registry as R

    path = scratch_path(spark, "registry")
    record = spark.createDataFrame([("draft", "2024-01-01T00:00:00Z")], "model_version string, trained_at string")
    record = record.select(*[record[f.name] if f.name in record.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in R.REGISTRY_SCHEMA.fields])
    with ThreadPoolExecutor(8) as pool:
        got = sorted(r.first()["model_version"] for r in pool.map(lambda _: R.append_run(record, path), range(8)))
    assert got == [f"v{k}" for k in range(1, 9)]
    assert sorted(r["model_version"] for r in spark.read.parquet(path).collect()) == got
    assert R.append_run(record, path).first()["model_version"] == "v9"


def test_early_stopping_keeps_the_best_rounds(spark, days):
    import random

    from tsspark.config import Settings, overlay
    from tsspark.operators.trees import best_round, rounds
    from tsspark.plans import training

    assert [best_round(e, 2) for e in ([5, 4, 3], [5, 4, 6, 7, 1], [5, 4, 6, 3, 9, 9], [1.0])] == [3, 2, 4, 1]
    rng = random.Random(2)
    rows = [(e, d, 10.0 + rng.gauss(0, 3) + (i % 7) * (e == "A")) for e in "AB" for i, d in enumerate(days("2024-01-01", 90))]
    df = spark.createDataFrame(rows, "entity string, date string, target double").withColumn("date", F.col("date").cast("date"))
    settings = overlay(Settings(), {"trees": {"n_trees": 25, "max_depth": 3, "learning_rate": 0.5, "inner_share": 0.3, "patience": 3}})
    early, _ = training.fit_on_history(df, settings)
    assert 0 < rounds(early) < 25
    whole, _ = training.fit_on_history(df, overlay(settings, {"trees": {"n_trees": rounds(early)}}))
    assert early.stages[-1].toDebugString.split("\n", 1)[1] == whole.stages[-1].toDebugString.split("\n", 1)[1]
