import pytest
from pyspark.sql import functions as F

from tsspark.operators import clean as C
from tsspark.operators import validate as V
from tsspark.plans.etl import run_generic, run_retail

PANEL = "date date, entity string, target double"


@pytest.fixture
def valid(frame):
    return frame(
        [("2020-01-01", "A", 100.0), ("2020-01-02", "A", 102.0), ("2020-01-03", "A", 98.0), ("2020-01-01", "B", 200.0), ("2020-01-02", "B", 205.0)],
        PANEL,
    )


@pytest.fixture
def gaps(frame):
    return frame(
        [("2020-01-01", "A", 10.0), ("2020-01-03", "A", 14.0), ("2020-01-01", "B", 20.0), ("2020-01-02", "B", 22.0), ("2020-01-03", "B", 24.0)],
        PANEL,
    )


def test_valid_panel_passes(valid):
    V.validate_retail(valid)


def test_missing_column_is_named(valid):
    with pytest.raises(ValueError, match="entity"):
        V.validate_retail(valid.drop("entity"))


def test_duplicate_key_is_reported(valid):
    with pytest.raises(ValueError, match="[Dd]uplicate"):
        V.validate_retail(valid.unionByName(valid.limit(1)))


def test_negative_target_is_reported_with_minimum(valid):
    with pytest.raises(ValueError, match="Min value: -7"):
        V.validate_retail(valid.withColumn("target", F.when(F.col("target") == 98, -7.0).otherwise(F.col("target"))))


def test_text_date_and_text_target_are_refused(valid):
    with pytest.raises(ValueError, match="datetime"):
        V.validate_retail(valid.withColumn("date", F.col("date").cast("string")))
    with pytest.raises(ValueError, match="numeric"):
        V.validate_retail(valid.withColumn("target", F.col("target").cast("string")))


def test_schema_report_names_missing_date(spark):
    row = V.validate_schema(spark.createDataFrame([(1.0,), (2.0,)], "target double")).first()
    assert not row["valid"] and any("date" in e for e in row["errors"]) and row["n_rows"] == 2


def test_schema_report_warns_about_extra_columns(valid):
    row = V.validate_schema(valid, allow_extra=False).first()
    assert row["valid"] and row["warnings"] == ["Unexpected columns (allowed by config): entity"]


def test_schema_report_names_wrong_types_together(spark):
    row = V.validate_schema(spark.createDataFrame([("x", "y")], "date string, target string")).first()
    assert len(row["errors"]) == 2


def test_data_report_lists_all_problems(frame):
    df = frame([("2020-01-01", "A", None), ("2020-01-01", "A", 1.0)], PANEL)
    row = V.validate_data(df, series="entity", min_rows=5).first()
    assert row["errors"] == [
        "Too few rows: 2 < 5.",
        "Missing values in 'target': 1.",
        "Duplicate (date, series) ratio 0.5000 exceeds max 0.0.",
    ]
    assert V.validate_data(df, series="entity", allow_missing=True, max_duplicate_ratio=0.5).first()["valid"]


def test_data_report_of_nothing(frame):
    row = V.validate_data(frame([], PANEL)).first()
    assert row["n_rows"] == 0 and row["errors"] == ["Too few rows: 0 < 1."]


def test_data_report_names_unknown_series_column(valid):
    assert "shop" in V.validate_data(valid, series="shop").first()["errors"][0]


def test_duplicate_examples_come_in_file_order(frame):
    df = frame(
        [("2020-01-01", "A", 1.0, 0), ("2020-01-02", "B", 2.0, 1), ("2020-01-02", "B", 3.0, 2), ("2020-01-03", "C", 4.0, 3), ("2020-01-03", "C", 5.0, 4), ("2020-01-03", "C", 6.0, 5)],
        PANEL + ", at int",
    )
    assert [r["at"] for r in V.duplicate_examples(df, ["entity", "date"], ["at"]).collect()] == [1, 2]
    assert [r["at"] for r in V.duplicate_examples(df, ["entity", "date"], ["at"], 5).orderBy("at").collect()] == [1, 2, 3, 4, 5]


def test_monotonic_check_finds_repeated_dates(valid):
    assert V.monotonic_check(valid).isEmpty()
    assert [r["entity"] for r in V.monotonic_check(valid.unionByName(valid.where("entity = 'B'"))).collect()] == ["B"]


def test_forward_fill_keeps_raw_target_missing(gaps):
    out = C.clean_retail(gaps).where("entity = 'A'").orderBy("date").collect()
    assert [r["target"] for r in out] == [10.0, None, 14.0]
    assert [r["target_cleaned"] for r in out] == [10.0, 10.0, 14.0]


def test_zero_fill(gaps):
    out = C.clean_retail(gaps, strategy="zero").where("entity = 'A'").orderBy("date").collect()
    assert [r["target_cleaned"] for r in out] == [10.0, 0.0, 14.0]


def test_global_span_leaves_leading_gap_missing(frame):
    df = frame([("2020-01-01", "A", 1.0), ("2020-01-04", "A", 4.0), ("2020-01-03", "B", 3.0)], PANEL)
    out = C.clean_retail(df, span="global").where("entity = 'B'").orderBy("date").collect()
    assert [r["target_cleaned"] for r in out] == [None, None, 3.0, 3.0]


def test_without_reindex_other_columns_stay(gaps):
    out = C.clean_retail(gaps.withColumn("promo", F.lit(1)), reindex=False, clip=C.ClipRule(upper=20))
    assert "promo" in out.columns and out.count() == 5 and out.agg(F.max("target_cleaned")).first()[0] == 20.0


def test_reindex_drops_other_columns(gaps):
    assert set(C.clean_retail(gaps.withColumn("promo", F.lit(1))).columns) == {"date", "entity", "target", "target_cleaned"}


def test_quartile_clip(frame, days):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = frame([(d, "A", v) for d, v in zip(days("2020-01-01", 5), values, strict=True)], PANEL)
    top = C.clip_outliers(df, C.ClipRule(by_quartiles=True), "target").agg(F.max("target")).first()[0]
    assert top == 7.0  # quartiles 2 and 4
    bounded = C.clip_outliers(df, C.ClipRule(by_quartiles=True, upper=50.0), "target").agg(F.max("target")).first()[0]
    assert bounded == 50.0


def test_clip_leaves_missing_values_missing(frame):
    df = frame([("2020-01-01", "A", None), ("2020-01-02", "A", 9.0)], PANEL)
    out = C.clean_values(df, drop_null=False, lower=1, upper=5).orderBy("date").collect()
    assert [r["target"] for r in out] == [None, 5.0]


def test_keep_first_needs_an_order(valid):
    with pytest.raises(ValueError, match="order"):
        C.clean_values(valid, unique_by=["entity", "date"])


def test_keep_first_is_cut_before_the_shuffle(valid):
    plan = C.keep_first(valid, ["entity"], ["date"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_clean_dates_reads_zone_first(spark):
    df = spark.sql("SELECT timestamp'2020-01-01 23:30:00' AS date")
    assert str(C.clean_dates(df).first()["date"]) == "2020-01-01"
    assert str(C.clean_dates(df, timezone="Asia/Tokyo").first()["date"]) == "2020-01-02"


def test_generic_run_stops_on_bad_data(frame):
    with pytest.raises(ValueError, match="Missing values"):
        run_generic(frame([("2020-01-01", "A", None)], PANEL))
    with pytest.raises(ValueError, match="Schema"):
        run_generic(frame([("2020-01-01", "A", 1.0)], PANEL).drop("target"))


def test_retail_run_checks_then_cleans(gaps):
    assert run_retail(gaps).count() == 6
    with pytest.raises(ValueError):
        run_retail(gaps.unionByName(gaps))


@pytest.mark.parametrize("span", ["per_entity", "global"])
@pytest.mark.parametrize("strategy", ["forward_fill", "zero"])
def test_counts_of_filled_values_without_unfolding(frame, span, strategy):
    from collections import Counter

    from tsspark.operators.clean import fill_missing, filled_counts, reindex_daily

    rows = [("2020-01-03", "A", 5.0), ("2020-01-04", "A", None), ("2020-01-09", "A", 7.0), ("2020-01-01", "B", None), ("2020-01-12", "B", 5.0), ("2020-01-05", "C", 1.0), (None, "C", 2.0)]
    df = frame(rows, "date date, entity string, target double")
    whole = fill_missing(reindex_daily(df, span=span), strategy)
    want = Counter(r["target_cleaned"] for r in whole.collect() if r["target_cleaned"] is not None)
    got = Counter()
    for r in filled_counts(df, strategy, "entity", "date", "target", span).collect():
        if r["value"] is not None:
            got[r["value"]] += r["w"]
    assert got == want
