from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsspark.functions.offsets import Offset, advance, parse
from tsspark.operators.forecast import seasonal_naive

OFFSETS = ["D", "3D", "W", "W-MON", "2W-THU", "ME", "2ME", "MS", "BME", "BMS", "QE", "QE-JAN", "2QE-OCT", "QS", "QS-FEB", "YE", "YE-MAR", "YS", "3YS-AUG"]


@pytest.mark.parametrize("text", [*OFFSETS, "B", "5B"])
def test_same_dates_as_pandas(spark, text):
    days = [date(2023, 11, 20) + timedelta(days=k) for k in range(140)] + [date(2024, 12, 31), date(2025, 2, 28), date(2024, 2, 29)]
    df = spark.createDataFrame([(d.isoformat(),) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    steps = df.select("d", F.explode(F.array(*map(F.lit, (1, 2, 3, 7, 13)))).alias("k"))
    got = {(r["d"], r["k"]): r["at"] for r in steps.select("d", "k", advance(F.col("d"), F.col("k"), text).alias("at")).collect()}
    step = pd.tseries.frequencies.to_offset(text)
    assert got == {(d, k): (pd.Timestamp(d) + step * k).date() for d in days for k in (1, 2, 3, 7, 13)}


@pytest.mark.parametrize("text", ["h", "6h", "15min", "90s"])
def test_clock_units_keep_the_time_of_day(spark, text):
    at = datetime(2024, 2, 28, 22, 50, 30)
    df = spark.createDataFrame([(at,)], "t timestamp_ntz").select(F.col("t"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k"))
    got = {r["k"]: r["at"] for r in df.select("k", advance(F.col("t"), F.col("k"), text).alias("at")).collect()}
    assert got == {k: (pd.Timestamp(at) + pd.tseries.frequencies.to_offset(text) * k).to_pydatetime() for k in range(1, 31)}


def test_parse_refuses_what_it_does_not_know():
    assert parse("12h") == Offset("h", 12) and parse("W-SUN") == Offset("W", 1, "SUN") and parse(Offset("B")) == Offset("B")
    for text in ("", "X", "0D", "ME-JAN", "W-JAN", "QE-MON", "D-MON", "1.5h", "-1D"):
        with pytest.raises(ValueError, match="offset"):
            parse(text)


def test_naive_forecast_on_other_calendars(frame):
    rows = [("a", f"2024-{m:02d}-{d}", float(m)) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30))] + [("b", "2024-01-31", 9.0)]
    df = frame(rows, "entity string, date date, target double")
    out = seasonal_naive(df, 5, k=3, offset="ME", report_short=True).orderBy("entity_id", "step").collect()
    assert [(r["entity_id"], str(r["date"]), r["y_pred"], r["status"]) for r in out] == [
        ("a", "2024-05-31", 2.0, "ok"), ("a", "2024-06-30", 3.0, "ok"), ("a", "2024-07-31", 4.0, "ok"), ("a", "2024-08-31", 2.0, "ok"), ("a", "2024-09-30", 3.0, "ok"),
        ("b", "None", None, "insufficient_history"),
    ]
    assert "status" not in seasonal_naive(df, 5, k=3, offset="ME").columns
