import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.functions import draws
from tsspark.operators import augment as A
from tsspark.operators import registry as R
from tsspark.session import scratch_path
from tsspark.sources import files

PANEL = "date date, entity string, target double"
ALL = {"missing": A.MissingBlocks(2, 2, 4), "noise": A.NoiseShift(1, 0.5, 2.0), "trend": A.TrendChange(1, 5, 8)}


@pytest.fixture
def panel(frame, days):
    d = days("2020-01-01", 40)
    return frame([(x, e, 100.0 + i) for e in "AB" for i, x in enumerate(d)], PANEL)


def rows(df):
    return df.orderBy("entity", "date").collect()


def test_same_seed_same_rows_in_any_partitioning(panel):
    first = rows(A.augment_timeseries(panel, 1, **ALL))
    assert rows(A.augment_timeseries(panel.repartition(5), 1, **ALL)) == first
    assert rows(A.augment_timeseries(panel, 2, **ALL)) != first


def test_entities_do_not_depend_on_each_other(panel):
    alone = rows(A.augment_timeseries(panel.where("entity = 'B'"), 1, **ALL))
    assert [r for r in rows(A.augment_timeseries(panel, 1, **ALL)) if r["entity"] == "B"] == alone


def test_original_is_kept_and_tags_are_ordered(panel):
    out = rows(A.augment_timeseries(panel, 1, **ALL))
    assert all(r["target"] == r["target_original"] for r in out) and len(out) == 80
    assert {r["augmentation_type"] for r in out} <= {
        "noise_shift", "missing_block,noise_shift", "noise_shift,trend", "missing_block,noise_shift,trend",
        "missing_block,missing_block,noise_shift", "missing_block,missing_block,noise_shift,trend",
    }
    for r in out:
        assert (r["target_augmented"] is None) == r["augmentation_type"].startswith("missing_block")


def test_untouched_without_rules(panel):
    out = rows(A.augment_timeseries(panel, 1))
    assert {r["augmentation_type"] for r in out} == {"original"} and all(r["target_augmented"] == r["target"] for r in out)


def test_trend_rises_from_the_window_start(panel):
    out = rows(A.augment_timeseries(panel, 3, trend=A.TrendChange(1, 6, 6, 2.0, 2.0)))
    for entity in "AB":
        hit = [r for r in out if r["entity"] == entity and r["augmentation_type"] == "trend"]
        assert [r["target_augmented"] - r["target"] for r in hit] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]


def test_short_series(frame):
    out = rows(A.augment_timeseries(frame([("2020-01-01", "A", 1.0)], PANEL), 1, **ALL))
    assert len(out) == 1


def test_noise_has_the_asked_size_and_can_be_off(panel, spark):
    wide = spark.range(20000).select(F.col("id").alias("entity"), F.lit("d").alias("date"), F.lit(0.0).alias("target"))
    spread = A.gaussian_noise(wide, 5, noise_std=3.0).agg(F.avg("target"), F.stddev_samp("target")).first()
    assert abs(spread[0]) < 0.1 and abs(spread[1] - 3.0) < 0.1
    assert A.gaussian_noise(panel, 5, noise_std=0.0) is panel and A.augment(panel, 5, add_noise=True, noise_std=1.0) is panel
    constant = wide.withColumn("target", F.lit(1.0))
    assert abs(A.gaussian_noise(constant, 5, noise_scale=2.0).agg(F.stddev_samp("target")).first()[0] - 2.0) < 0.1


def test_draws_are_uniform(spark):
    got = spark.range(20000).select(draws.uniform(1, F.col("id")).alias("u"), draws.integer(1, F.lit(2), F.lit(5), F.col("id")).alias("k"))
    row = got.agg(F.min("u"), F.max("u"), F.avg("u"), F.min("k"), F.max("k")).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.01 and (row[3], row[4]) == (2, 4)


# ---- files

TEXT = T.StructType().add("entity", T.StringType()).add("date", T.DateType()).add("target", T.DoubleType())


def csv(spark, lines):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_retail_csv_round_trip(spark):
    path = csv(spark, ["date,entity,target,note", "2020-01-01,A,10,x", "2020-01-02,A,,y"])
    df = files.read_retail_csv(spark, path, TEXT)
    assert dict(df.dtypes) == {"date": "date", "entity": "string", "target": "double", "note": "string"}
    assert [r["target"] for r in df.orderBy("date").collect()] == [10.0, None]


def test_retail_csv_refuses_bad_files(spark):
    with pytest.raises(ValueError, match="unparseable"):
        files.read_retail_csv(spark, csv(spark, ["date,entity,target", "2020-01-01,A,1", "nonsense,A,1"]), TEXT)
    with pytest.raises(ValueError, match="no rows"):
        files.read_retail_csv(spark, csv(spark, ["date,entity,target"]), TEXT)
    with pytest.raises(ValueError, match="target"):
        files.read_retail_csv(spark, csv(spark, ["date,entity", "2020-01-01,A"]), TEXT)


def test_raw_csv_keeps_text_dates_on_request(spark):
    path = csv(spark, ["date,target", "2020-01-01,NaN"])
    assert dict(files.read_raw_csv(spark, path, TEXT).dtypes)["date"] == "date"
    assert dict(files.read_raw_csv(spark, path, TEXT, parse_dates=False).dtypes)["date"] == "string"
    assert files.read_raw_csv(spark, path, TEXT).first()["target"] is None  # NaN is missing


def test_sales_and_master_need_their_columns(spark):
    with pytest.raises(ValueError, match="Promo"):
        files.read_sales(spark, csv(spark, ["Date,Store,Sales,Open,StateHoliday,SchoolHoliday", "2015-01-01,1,1,1,0,0"]))
    with pytest.raises(ValueError, match="Assortment"):
        files.read_store_master(spark, csv(spark, ["Store,StoreType,CompetitionDistance", "1,a,5"]))


def test_empty_panel_is_not_written(spark, panel):
    path = scratch_path(spark, "none")
    assert not files.write_processed(panel.limit(0), path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert files.write_processed(panel, path) and files.read_processed(spark, path, ["entity"]).columns == ["entity"]


def test_column_list_reaches_the_scan(spark, panel):
    path = scratch_path(spark, "pruned")
    files.write_processed(panel, path)
    plan = files.read_processed(spark, path, ["entity", "date"]).where("entity = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "target" not in plan.split("ReadSchema:")[1] and "EqualTo(entity,A)" in plan


# ---- run records


def test_versions_count_up(spark):
    registry = spark.createDataFrame([("v2",), ("v10",), ("draft",)], "model_version string")
    assert spark.range(1).select(R.next_version(registry)).first()[0] == "v11"
    assert spark.range(1).select(R.next_version(registry.limit(0))).first()[0] == "v1"


def test_registry_check_names_problems(spark):
    good = ("v5", "2024-01-01T00:00:00Z", ("2020-01-01", "2020-12-31"), ["lag_1"], 4, 800, {"a": "1"}, 1.0, (1.0, 2.0, None), [("lag_1", 0.45)], 14, 14)
    bad = ("v6", None, ("2020-01-01", "2020-12-31"), ["lag_1"], -1, 800, {"a": "1"}, -1.0, (1.0, 2.0, None), [("lag_1", -0.1)], 14, 14)
    got = R.registry_check(spark.createDataFrame([good, bad], R.REGISTRY_SCHEMA)).orderBy("model_version").collect()
    assert got[0]["valid"] and got[1]["problems"] == ["trained_at missing", "feature_count negative", "residual_std negative", "importance negative"]
    with pytest.raises(ValueError, match="max_lag"):
        R.registry_check(spark.createDataFrame([good], R.REGISTRY_SCHEMA).drop("max_lag"))
