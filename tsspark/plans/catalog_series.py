"""Registered queries: one long series without an entity, other calendars, sketches, keyed tables."""

from __future__ import annotations

from datetime import date as Day

from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.operators import sketches as S
from tsspark.operators.clean import fill_missing, reindex_daily
from tsspark.operators.features import add_features
from tsspark.operators.forecast import seasonal_naive
from tsspark.operators.long_series import LongSeries
from tsspark.plans.catalog import SALES, SEGMENTS, pairs_cte, query, with_
from tsspark.plans.catalog_evaluation import PAIRS, points_sql, sales_pairs
from tsspark.session import scratch_path
from tsspark.sources import panels
from tsspark.sources.keyed import KeyedTable, newest
from tsspark.streaming import feeds, late, rolling

#: Small enough that the test tables have many blocks.
BLOCK_ROWS = 2_000


def _events(spark, sf_dir):
    """All events as one series, in the order of time and number."""
    return panels.table(spark, sf_dir, "events").select("ts", "event_id", F.col("value").alias("target"))


# ---- one series without an entity --------------------------------------------------------------------

ONE = "one AS (SELECT ts, event_id, value AS target FROM events)"
_PAST = "OVER (ORDER BY ts, event_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


@query(
    "features_one_series",
    with_(
        ONE,
        "SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS ts, target, "
        + ", ".join(f"lag(target, {k}) OVER (ORDER BY ts, event_id) AS lag_{k}" for k in (1, 7, 14))
        + ", "
        + ", ".join(f"round(avg(target) {_PAST.format(w=w)}, 6) AS rolling_mean_{w}, round(stddev_samp(target) {_PAST.format(w=w)}, 6) AS rolling_std_{w}" for w in (7, 14))
        + ", isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, weekofyear(ts) AS week_of_year, month(ts) AS month, "
        "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM one",
    ),
)
def features_one_series(spark, sf_dir):
    made = add_features(_events(spark, sf_dir), entity=None, date="ts", ties=("event_id",), block_rows=BLOCK_ROWS)
    return made.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "fill_one_series",
    with_(
        "one AS (SELECT ts, event_id, CASE WHEN event_id % 997 = 5 THEN value END AS target FROM events)",
        """SELECT event_id, target, last_value(target IGNORE NULLS) OVER (
               ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS target_cleaned FROM one""",
    ),
)
def fill_one_series(spark, sf_dir):
    """Values so rare that most blocks have none of their own."""
    rare = _events(spark, sf_dir).withColumn("target", F.when(F.col("event_id") % 997 == 5, F.col("target")))
    return fill_missing(rare, entity=None, date="ts", ties=("event_id",), block_rows=BLOCK_ROWS // 8).select("event_id", "target", "target_cleaned")


@query(
    "reindex_one_series",
    with_(
        "days AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS target FROM orders GROUP BY 1 HAVING day(CAST(o_orderdate AS DATE)) % 3 = 1)",
        """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date, target
           FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM days) LEFT JOIN days ON date = CAST(d AS DATE)""",
    ),
)
def reindex_one_series(spark, sf_dir):
    """Orders per day, known for every third day."""
    days = panels.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("target"))
    return reindex_daily(days.where(F.dayofmonth("date") % 3 == 1), entity=None, block_rows=50)


@query(
    "minutes_one_series",
    with_(
        "minutes AS (SELECT date_trunc('minute', ts) AS moment, CAST(count(*) AS DOUBLE) AS target FROM events GROUP BY 1)",
        "grid AS (SELECT unnest(generate_series(min(moment), max(moment), INTERVAL 1 MINUTE)) AS moment FROM minutes)",
        "filled AS (SELECT moment, target, last_value(target IGNORE NULLS) OVER (ORDER BY moment) AS target_cleaned FROM grid LEFT JOIN minutes USING (moment))",
        """SELECT CAST(moment AS VARCHAR) AS moment, target, target_cleaned, lag(target_cleaned, 60) OVER (ORDER BY moment) AS lag_60,
                  sum(target) OVER (ORDER BY moment ROWS BETWEEN 1440 PRECEDING AND 1 PRECEDING) AS last_day FROM filled""",
    ),
)
def minutes_one_series(spark, sf_dir):
    """A calendar of minutes: gaps, carried values, a lag and a day's sum in one chain over the same blocks."""
    minutes = panels.table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("moment"))
    series = LongSeries.of(minutes.agg(F.count(F.lit(1)).cast("double").alias("target")), "moment", BLOCK_ROWS)
    chain = series.unfold("target", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1))).carry_forward("target", "target_cleaned")
    chain = chain.windowed(1440, lambda w: {"lag_60": F.lag("target_cleaned", 60).over(w), "last_day": F.sum("target").over(w.rowsBetween(-1440, -1))})
    return chain.frame().withColumn("moment", F.date_format("moment", "yyyy-MM-dd HH:mm:ss"))


# ---- other calendars ---------------------------------------------------------------------------------


def _last_rows_sql(panel: str, k: int, entity: str = "entity") -> str:
    return f"""(SELECT {entity} AS entity, target, max(date) OVER (PARTITION BY {entity}) AS last_date, count(*) OVER (PARTITION BY {entity}) AS n,
                       row_number() OVER (PARTITION BY {entity} ORDER BY date DESC) AS back FROM {panel})"""


def _naive_sql(panel: str, k: int, horizon: int, at: str, entity: str = "entity") -> str:
    """``at``: the date of ``step`` after ``last_date``."""
    return f"""SELECT b.entity AS entity_id, CAST({at} AS VARCHAR) AS date, target AS y_pred, 'seasonal_naive' AS model_name, CAST(step AS INTEGER) AS step
               FROM {_last_rows_sql(panel, k, entity)} b JOIN (SELECT unnest(range(1, {horizon + 1})) AS step) ON b.back = {k} - (step - 1) % {k} WHERE b.n >= {k}"""


@query(
    "naive_hourly",
    with_(
        "hours AS (SELECT event_type AS entity, date_trunc('hour', ts) AS date, CAST(count(*) AS DOUBLE) AS target FROM events GROUP BY 1, 2)",
        _naive_sql("hours", 24, 48, "last_date + to_hours(CAST(step AS INTEGER))"),
    ),
)
def naive_hourly(spark, sf_dir):
    hours = panels.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"))
    out = seasonal_naive(hours.agg(F.count(F.lit(1)).cast("double").alias("target")), 48, k=24, offset="h")
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


@query(
    "naive_month_end",
    with_(
        SEGMENTS,
        "months AS (SELECT entity, last_day(date) AS date, sum(target) AS target FROM segments GROUP BY 1, 2)",
        _naive_sql("months", 12, 18, "last_day(last_date + to_months(CAST(step AS INTEGER)))"),
    ),
)
def naive_month_end(spark, sf_dir):
    months = panels.segment_daily(spark, sf_dir).groupBy("entity", F.last_day("date").alias("date")).agg(F.sum("target").alias("target"))
    return seasonal_naive(months, 18, k=12, offset="ME")


@query(
    "naive_business_day",
    with_(
        SALES,
        "work AS (SELECT * FROM sales WHERE isodow(date) < 6)",
        "grid AS (SELECT CAST(d AS DATE) AS d, row_number() OVER (ORDER BY d) AS i FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2005-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6)",
        f"SELECT f.entity_id, CAST(g.d AS VARCHAR) AS date, y_pred, model_name, step FROM ({_naive_sql('work', 5, 23, 'last_date')}) f JOIN grid s ON CAST(s.d AS VARCHAR) = f.date JOIN grid g ON g.i = s.i + step",
    ),
)
def naive_business_day(spark, sf_dir):
    work = panels.sales_daily(spark, sf_dir).where(F.weekday("date") < 5)
    return seasonal_naive(work, 23, k=5, offset="B")


@query(
    "naive_one_series",
    with_(
        "weeks AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_quantity) AS target FROM lineitem GROUP BY 1)",
        _naive_sql("weeks", 52, 60, "last_date + CAST(7 * step AS INTEGER)", "CAST(NULL AS VARCHAR)"),
    ),
)
def naive_one_series(spark, sf_dir):
    """Units per week of the whole house, weeks dated by their Monday, no entity."""
    weeks = panels.table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "week").alias("date")).agg(F.sum("l_quantity").alias("target"))
    return seasonal_naive(weeks, 60, k=52, entity=None, offset="W-MON")


# ---- sketches ----------------------------------------------------------------------------------------

SHARES = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(
    "sketch_quantiles",
    with_(
        SALES,
        "facts AS (SELECT count(*) AS n, count(DISTINCT date) AS days, min(target) AS least, max(target) AS greatest FROM sales)",
        f"SELECT unnest([{', '.join(f'CAST({s} AS DOUBLE)' for s in SHARES)}]) AS share, CAST(n AS BIGINT) AS n, days, least, greatest, TRUE AS within_bound FROM facts",
    ),
)
def sketch_quantiles(spark, sf_dir):
    """Quantiles of a panel that grew by its last year: are their exact ranks within the bound?"""
    panel = panels.sales_daily(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("date")
    days = S.append_days(S.daily_sketches(panel.where(F.col("date") < cut), "target"), S.daily_sketches(panel.where(F.col("date") >= cut), "target"))
    merged = S.merged_sketches(days).crossJoin(days.agg(F.count(F.lit(1)).alias("days")))
    found = S.sketch_quantiles(days, SHARES).select(F.posexplode("quantiles").alias("at", "value"))
    below = [F.count_if(F.col("target") < F.col("value")).alias("below"), F.count_if(F.col("target") <= F.col("value")).alias("upto"), F.count(F.lit(1)).alias("all")]
    ranks = panel.crossJoin(F.broadcast(found)).groupBy("at").agg(*below)  # one row per share
    share = F.get(F.array(*map(F.lit, SHARES)), F.col("at"))
    error = F.lit(S.rank_error())
    within = (F.col("below") / F.col("all") <= share + error) & (F.col("upto") / F.col("all") >= share - error)
    return ranks.crossJoin(merged).select(share.alias("share"), "n", "days", "least", "greatest", within.alias("within_bound"))


# ---- keyed tables ------------------------------------------------------------------------------------


@query(
    "keyed_errors",
    with_(*PAIRS, f"points AS ({points_sql('pairs')})", "SELECT entity, CAST(date AS VARCHAR) AS date, abs_error, ape FROM points"),
    digits=8,
)
def keyed_errors(spark, sf_dir):
    """Deliveries out of order: even months, then wrong scores for all, recorded earlier, then odd months."""
    arriving, progress = scratch_path(spark, "pairs"), scratch_path(spark, "progress")
    pairs = sales_pairs(spark, sf_dir).persist(StorageLevel.DISK_ONLY)  # three deliveries are taken from it
    table = feeds.errors_table(spark, scratch_path(spark, "errors"), entity_type=pairs.schema["entity"].dataType, bucket_days=180)
    right, wrong = pairs.withColumn("at", F.lit(2)), pairs.withColumns({"y_pred": F.col("y_pred") + 100, "at": F.lit(1)})
    for delivery in (right.where(F.month("date") % 2 == 0), wrong, right.where(F.month("date") % 2 == 1)):
        delivery.write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(right.schema).parquet(arriving)
        feeds.errors_table_sink(stream, table, progress, "at").awaitTermination()
    pairs.unpersist()
    return table.read().drop("age")


@query(
    "keyed_sales",
    with_(SALES, "SELECT entity, CAST(date AS VARCHAR) AS date, target FROM sales WHERE date >= DATE '1996-03-10' AND date <= DATE '1996-05-20'"),
)
def keyed_sales(spark, sf_dir):
    """A panel kept by key in four batches, the later ones correcting; a span of dates opens its buckets only."""
    panel = panels.sales_daily(spark, sf_dir)
    schema = T.StructType([T.StructField("entity", panel.schema["entity"].dataType), T.StructField("date", T.DateType()), T.StructField("target", T.DoubleType())])
    table = KeyedTable(spark, scratch_path(spark, "sales"), schema, ("entity", "date"), bucket_days=180)
    for k in range(4):
        part = panel.where(F.pmod(F.xxhash64("entity", "date"), F.lit(4)) >= k)
        table.upsert(part.withColumn("target", F.col("target") + (3 - k)), newest(("entity", "date"), ()), ("loads", k))
    kept = table.read(Day(1996, 3, 10), Day(1996, 5, 20))
    fresh = F.least(F.pmod(F.xxhash64("entity", "date"), F.lit(4)), F.lit(3))
    return kept.withColumn("target", F.col("target") - (3 - fresh))


# ---- streams with state --------------------------------------------------------------------------------


@query("late_sales", with_(SEGMENTS, "SELECT entity, CAST(date AS VARCHAR) AS date, target FROM segments"))
def late_sales(spark, sf_dir):
    """Three deliveries: wrong values up to 1996, then all days of even months late and right, then the rest."""
    arriving, progress, side = (scratch_path(spark, n) for n in ("sales", "progress", "side"))
    panel = panels.segment_daily(spark, sf_dir)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in panel.schema.fields])
    table = KeyedTable(spark, scratch_path(spark, "panel"), schema, ("entity", "date"), bucket_days=180)
    early = (F.col("date") < F.lit("1997-01-01").cast("date")) & (F.month("date") % 2 == 0)
    for delivery in (panel.where(early).withColumn("target", F.col("target") + 1), panel.where(F.month("date") % 2 == 0), panel.where(F.month("date") % 2 == 1)):
        delivery.write.mode("append").parquet(arriving)
        late.late_sales_sink(spark.readStream.schema(schema).parquet(arriving), 30, table, side, progress).awaitTermination()
    late.merge_side(spark, table, side)
    return table.read()


def windows_sql(w: int) -> str:
    return f"""SELECT entity, CAST(date AS VARCHAR) AS date, round(CAST(avg(CAST(abs_error AS DECIMAL(28, 8))) OVER o AS DOUBLE), 6) AS mae,
                      round(100 * CAST(avg(CAST(ape AS DECIMAL(28, 8))) OVER o AS DOUBLE), 4) AS mape
               FROM points WINDOW o AS (PARTITION BY entity ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)
               QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date) >= {w}"""


@query(
    "rolling_errors_stream",
    with_(
        SEGMENTS, pairs_cte("segments"), f"points AS ({points_sql('pairs')})", windows_sql(14),
    ),
)
def rolling_errors_stream(spark, sf_dir):
    """Even days first, then odd ones: every window is emitted again as the points between arrive."""
    arriving, progress = scratch_path(spark, "pairs"), scratch_path(spark, "progress")
    pairs = panels.forecast_pairs(panels.segment_daily(spark, sf_dir))
    errors = feeds.errors_table(spark, scratch_path(spark, "errors"), bucket_days=180)
    windows = rolling.rolling_table(spark, scratch_path(spark, "windows"), bucket_days=180)
    for parity in (0, 1):
        pairs.where(F.pmod(F.unix_date("date"), F.lit(2)) == parity).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(pairs.schema).parquet(arriving)
        rolling.rolling_sink(stream, 14, 60, errors, windows, progress).awaitTermination()
    return windows.read()
