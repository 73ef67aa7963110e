import pytest
from pyspark.sql import functions as F

from tsspark.operators import store_sales as S

ORDER = ["Date", "Store"]


@pytest.fixture
def sales(frame):
    rows = zip(
        ["2015-01-01", "2015-01-02", "2015-01-03"] * 2, [1, 1, 1, 2, 2, 2], [100.0, 105.0, 98.0, 200.0, 210.0, 195.0],
        [1, 1, 1, 1, 0, 1], [0, 1, 0, 0, 1, 0], ["0"] * 6, [0, 0, 1, 0, 0, 1], strict=True,
    )
    return frame(list(rows), "Date date, Store bigint, Sales double, Open int, Promo int, StateHoliday string, SchoolHoliday int")


@pytest.fixture
def master(spark):
    return spark.createDataFrame([(1, "a", "a", 100.0), (2, "b", "b", None)], "Store bigint, StoreType string, Assortment string, CompetitionDistance double")


def test_closed_days_sell_nothing_but_stay(sales, master):
    out = S.store_sales(sales, master, ORDER)
    assert out.count() == 6
    closed = out.where("open = 0").collect()
    assert [(r["target_raw"], r["target_cleaned"]) for r in closed] == [(210.0, 0.0)]


def test_missing_distance_becomes_row_weighted_median(sales, master):
    out = S.store_sales(sales, master, ORDER)
    assert {r["competition_distance"] for r in out.where("store_id = 2").collect()} == {100.0}


def test_median_counts_rows_not_stores(frame, spark):
    base = frame([("2015-01-01", 1, 1.0, 1, 0, "0", 0)], "Date date, Store bigint, Sales double, Open int, Promo int, StateHoliday string, SchoolHoliday int")
    many = base.unionByName(base.withColumn("Date", F.lit("2015-01-02").cast("date"))).unionByName(base.withColumn("Store", F.lit(2).cast("bigint"))).unionByName(base.withColumn("Store", F.lit(3).cast("bigint")))
    stores = spark.createDataFrame([(1, "a", "a", 10.0), (2, "a", "a", 40.0), (3, "a", "a", None)], "Store bigint, StoreType string, Assortment string, CompetitionDistance double")
    assert S.store_sales(many, stores, ORDER).where("store_id = 3").first()["competition_distance"] == 10.0


def test_no_distance_at_all_becomes_zero(sales, master):
    out = S.store_sales(sales, master.withColumn("CompetitionDistance", F.lit(None).cast("double")), ORDER)
    assert {r["competition_distance"] for r in out.collect()} == {0.0}


def test_both_arrangements_agree(sales, master):
    merged = S.normalize_schema(S.merge_store(sales, master))
    late = S.clean_store_sales(merged, ["date", "store_id"]).orderBy("store_id", "date").collect()
    early = S.store_sales(sales, master, ORDER).orderBy("store_id", "date").collect()
    assert [r.asDict() for r in late] == [r.asDict() for r in early]


def test_first_of_repeated_keys_wins(sales, master):
    doubled = sales.withColumn("at", F.lit(1)).unionByName(sales.withColumn("at", F.lit(2)).withColumn("Sales", F.lit(1.0)))
    out = S.store_sales(doubled, master, ["at"])
    assert out.count() == 6 and out.agg(F.min("target_raw")).first()[0] == 98.0
    S.assert_increasing(out)


def test_rows_without_keys_are_dropped(sales, master):
    holes = sales.withColumn("Store", F.when(F.col("Sales") != 98, F.col("Store")))
    assert S.store_sales(holes, master, ORDER).count() == 5


def test_missing_flag_counts_as_open(sales, master):
    unknown = sales.withColumn("Open", F.lit(None).cast("int"))
    assert S.store_sales(unknown, master, ORDER).where("target_cleaned = 0").isEmpty()


def test_types_are_enforced(sales, master):
    types = dict(S.store_sales(sales, master, ORDER).dtypes)
    assert (types["store_id"], types["open"], types["promo"]) == ("bigint", "bigint", "bigint")
    assert (types["target_raw"], types["target_cleaned"], types["state_holiday"]) == ("double", "double", "string")


def test_clashing_names_get_a_suffix(sales, master):
    out = S.merge_store(sales, master.withColumn("Promo", F.lit(9)))
    assert "Promo" in out.columns and "Promo_store" in out.columns


def test_missing_input_columns(sales, master):
    with pytest.raises(ValueError, match="Store"):
        S.merge_store(sales.drop("Store"), master)
    with pytest.raises(ValueError, match="Open"):
        S.normalize_schema(S.merge_store(sales.drop("Open"), master))


def test_repeated_date_is_an_error(sales, master):
    out = S.store_sales(sales, master, ORDER)
    with pytest.raises(AssertionError):
        S.assert_increasing(out.unionByName(out))
