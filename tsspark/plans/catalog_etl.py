"""Registered queries: files, validation, cleaning, store sales, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.operators import augment as A
from tsspark.operators import clean as C
from tsspark.operators import store_sales as SS
from tsspark.operators import validate as V
from tsspark.operators.forecast import seasonal_naive
from tsspark.plans.catalog import (
    MASTER, RAW, RAW_STORE, SALES, SEGMENTS, naive_cte, query, with_,
)
from tsspark.plans.etl import run_generic, run_retail, run_store_sales
from tsspark.session import scratch_path
from tsspark.sources import files, panels

FILE_ORDER = ["l_orderkey", "l_linenumber"]
TEXT_PANEL = T.StructType().add("entity", T.StringType()).add("date", T.DateType()).add("target", T.DoubleType())
KEY_PANEL = T.StructType().add("entity", T.LongType()).add("date", T.DateType()).add("target", T.DoubleType())

SHOW_SEGMENTS = "SELECT entity, CAST(date AS VARCHAR) AS date, target FROM segments"
SHOW_SALES = "SELECT entity, CAST(date AS VARCHAR) AS date, target FROM sales"


# ---- files -----------------------------------------------------------------------------------------


@query("read_raw_csv", with_(SEGMENTS, SHOW_SEGMENTS))
def read_raw_csv(spark, sf_dir):
    path = scratch_path(spark, "segments-csv")
    files.export_csv(panels.segment_daily(spark, sf_dir), path)
    return files.read_raw_csv(spark, path, TEXT_PANEL)


@query("read_retail_csv", with_(SALES, SHOW_SALES))
def read_retail_csv(spark, sf_dir):
    path = scratch_path(spark, "sales-csv")
    files.export_csv(panels.sales_daily(spark, sf_dir), path)
    return files.read_retail_csv(spark, path, KEY_PANEL)


@query(
    "read_sales",
    with_(RAW_STORE, 'SELECT CAST("Date" AS VARCHAR) AS "Date", "Store", "Sales", "Open", "Promo", "StateHoliday", "SchoolHoliday" FROM raw_store'),
)
def read_sales(spark, sf_dir):
    path = scratch_path(spark, "store-sales-csv")
    files.export_csv(panels.raw_store_sales(spark, sf_dir).drop(*FILE_ORDER), path)
    return files.read_sales(spark, path)


@query("read_store_master", with_(MASTER, 'SELECT "Store", "StoreType", "Assortment", round("CompetitionDistance", 6) AS "CompetitionDistance" FROM master'))
def read_store_master(spark, sf_dir):
    path = scratch_path(spark, "master-csv")
    files.export_csv(panels.store_master(spark, sf_dir), path)
    return files.read_store_master(spark, path)


@query("read_processed", with_(SALES, SHOW_SALES))
def read_processed(spark, sf_dir):
    path = scratch_path(spark, "processed")
    files.write_processed(panels.sales_daily(spark, sf_dir), path)
    return files.read_processed(spark, path)


@query("read_processed_columns", with_(SALES, "SELECT entity, CAST(date AS VARCHAR) AS date FROM sales"))
def read_processed_columns(spark, sf_dir):
    path = scratch_path(spark, "processed")
    files.write_processed(panels.sales_daily(spark, sf_dir), path)
    return files.read_processed(spark, path, ["entity", "date"])


@query("write_processed", with_(SEGMENTS, SHOW_SEGMENTS))
def write_processed(spark, sf_dir):
    path, unused = scratch_path(spark, "processed"), scratch_path(spark, "processed")
    panel = panels.segment_daily(spark, sf_dir)
    written = files.write_processed(panel, path)
    written_empty = files.write_processed(panel.where(F.col("target") < 0), unused)
    if not written or written_empty:
        raise AssertionError("a panel with rows is written, an empty one is not")
    return spark.read.parquet(path)


@query(
    "write_predictions",
    with_(
        SALES,
        naive_cte("sales", 14),
        """SELECT f.kind, entity_id, CAST(date AS VARCHAR) AS date, y_pred, model_name, step
           FROM naive, (SELECT unnest(['csv', 'parquet']) AS kind) f""",
    ),
)
def write_predictions(spark, sf_dir):
    made = seasonal_naive(panels.sales_daily(spark, sf_dir), 14)
    as_csv, as_parquet = scratch_path(spark, "predictions") + ".csv", scratch_path(spark, "predictions")
    files.write_predictions(made, as_csv)
    files.write_predictions(made, as_parquet)
    back = spark.read.schema(made.schema).option("header", True).csv(as_csv).withColumn("kind", F.lit("csv"))
    return back.unionByName(spark.read.parquet(as_parquet).withColumn("kind", F.lit("parquet")))


@query(
    "etl_summary",
    with_(SALES, """SELECT count(*) AS rows, CAST(min(date) AS VARCHAR) AS date_min, CAST(max(date) AS VARCHAR) AS date_max,
                           count(DISTINCT entity) AS entities FROM sales"""),
)
def etl_summary(spark, sf_dir):
    return files.etl_summary(panels.sales_daily(spark, sf_dir))


# ---- validation ------------------------------------------------------------------------------------


def _joined(df, *names):
    return df.withColumns({n: F.array_join(n, "; ") for n in names})


@query(
    "validate_schema",
    """SELECT true AS valid, '' AS errors,
              'Unexpected columns (allowed by config): entity, l_linenumber, l_orderkey' AS warnings,
              count(*) AS n_rows FROM lineitem""",
)
def validate_schema(spark, sf_dir):
    return _joined(V.validate_schema(panels.raw_series(spark, sf_dir), allow_extra=False), "errors", "warnings")


@query(
    "validate_data",
    with_(
        RAW,
        """SELECT n_rows, n_unique, n_null, round(ratio, 6) AS duplicate_ratio,
                  concat_ws('; ', CASE WHEN n_rows < 1000000 THEN printf('Too few rows: %d < 1000000.', n_rows) END,
                            CASE WHEN ratio > 0.01 THEN printf('Duplicate (date, series) ratio %.4f exceeds max 0.01.', ratio) END) AS errors,
                  false AS valid
           FROM (SELECT n_rows, n_unique, n_null, 1.0 - n_unique / n_rows AS ratio FROM (
               SELECT count(*) AS n_rows, count(*) - count(target) AS n_null,
                      count(DISTINCT (date, entity)) AS n_unique FROM raw))""",
    ),
)
def validate_data(spark, sf_dir):
    found = V.validate_data(
        panels.raw_series(spark, sf_dir), series="entity", min_rows=1000000, max_duplicate_ratio=0.01
    )
    return _joined(found, "errors")


@query(
    "validate_retail",
    with_(
        RAW,
        """SELECT CAST(sum(held) AS BIGINT) AS n_rows, CAST(sum(held - 1) AS BIGINT) AS n_duplicates,
                  CAST(sum(negative) AS BIGINT) AS n_negative, min(least) AS min_target,
                  count(DISTINCT CASE WHEN held > 1 THEN entity END) AS n_not_increasing
           FROM (SELECT entity, date, count(*) AS held, count(*) FILTER (target < 0) AS negative, min(target) AS least
                 FROM raw GROUP BY 1, 2)""",
    ),
)
def validate_retail(spark, sf_dir):
    return V.retail_report(panels.raw_series(spark, sf_dir))


@query(
    "duplicate_examples",
    with_(
        RAW,
        """SELECT entity, CAST(date AS VARCHAR) AS date, target, l_orderkey, l_linenumber
           FROM (SELECT *, count(*) OVER (PARTITION BY entity, date) AS held FROM raw)
           WHERE held > 1 ORDER BY l_orderkey, l_linenumber LIMIT 2""",
    ),
)
def duplicate_examples(spark, sf_dir):
    return V.duplicate_examples(panels.raw_series(spark, sf_dir), ["entity", "date"], FILE_ORDER)


@query(
    "monotonic_check",
    with_(
        RAW,
        """SELECT entity, count(*) AS n_rows, count(DISTINCT date) AS n_dates FROM raw
           GROUP BY entity HAVING count(*) > count(DISTINCT date)""",
    ),
)
def monotonic_check(spark, sf_dir):
    return V.monotonic_check(panels.raw_series(spark, sf_dir))


# ---- cleaning --------------------------------------------------------------------------------------


@query(
    "clean_dates",
    "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS ts, round(value, 6) AS value FROM events",
)
def clean_dates(spark, sf_dir):
    events = panels.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return C.clean_dates(events, "ts")


FIRST_ROWS = "QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


@query(
    "clean_values",
    with_(
        RAW,
        """SELECT entity, CAST(date AS VARCHAR) AS date, least(greatest(target, 5), 45) AS target, l_orderkey, l_linenumber
           FROM raw WHERE target IS NOT NULL """ + FIRST_ROWS.format(keys="entity, date", order="l_orderkey, l_linenumber"),
    ),
)
def clean_values(spark, sf_dir):
    return C.clean_values(
        panels.raw_series(spark, sf_dir), lower=5, upper=45, unique_by=["entity", "date"], order=FILE_ORDER
    )


@query(
    "clean",
    """SELECT event_id, user_id, CAST(day AS VARCHAR) AS ts, round(greatest(value, 1.0), 6) AS value
       FROM (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE value IS NOT NULL) """
    + FIRST_ROWS.format(keys="user_id, day", order="event_id"),
)
def clean(spark, sf_dir):
    events = panels.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return C.clean(events, date="ts", value="value", lower=1.0, unique_by=["user_id", "ts"], order=["event_id"])


def calendar_cte(panel: str, span: str, name: str = "full_days") -> str:
    ends = "min(date) AS a, max(date) AS b" if span == "per_entity" else f"(SELECT min(date) FROM {panel}) AS a, (SELECT max(date) FROM {panel}) AS b"
    return f"""{name} AS (
    SELECT c.entity, c.date, p.target FROM (
        SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
        FROM (SELECT entity, {ends} FROM {panel} GROUP BY entity)) c
    LEFT JOIN {panel} p ON c.entity = p.entity AND c.date = p.date)"""


SHOW_FULL = "SELECT entity, CAST(date AS VARCHAR) AS date, target FROM full_days"


@query("reindex_daily", with_(SALES, calendar_cte("sales", "per_entity"), SHOW_FULL))
def reindex_daily(spark, sf_dir):
    return C.reindex_daily(panels.sales_daily(spark, sf_dir))


@query("reindex_daily_global", with_(SEGMENTS, calendar_cte("segments", "global"), SHOW_FULL))
def reindex_daily_global(spark, sf_dir):
    return C.reindex_daily(panels.segment_daily(spark, sf_dir), span="global")


CARRIED = "last_value(target IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "fill_missing",
    with_(
        SEGMENTS,
        calendar_cte("segments", "global"),
        f"SELECT entity, CAST(date AS VARCHAR) AS date, target, {CARRIED} AS carried, coalesce(target, 0) AS zeroed FROM full_days",
    ),
)
def fill_missing(spark, sf_dir):
    days = C.reindex_daily(panels.segment_daily(spark, sf_dir), span="global")
    carried = C.fill_missing(days, "forward_fill", filled="carried")
    return C.fill_missing(carried, "zero", filled="zeroed")


def fences_cte(table: str, column: str) -> str:
    return f"""fences AS (
    SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
        SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {table}))"""


CLIPPED = "round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, low), high) END, 6)"


@query(
    "clip_outliers",
    with_(
        SALES, fences_cte("sales", "target"),
        f"SELECT entity, CAST(date AS VARCHAR) AS date, {CLIPPED.format(c='target')} AS target FROM sales, fences",
    ),
)
def clip_outliers(spark, sf_dir):
    return C.clip_outliers(panels.sales_daily(spark, sf_dir), C.ClipRule(by_quartiles=True), "target")


RETAIL_SQL = with_(
    SALES,
    calendar_cte("sales", "per_entity"),
    f"filled AS (SELECT *, {CARRIED} AS carried FROM full_days)",
    fences_cte("filled", "carried"),
    f"SELECT entity, CAST(date AS VARCHAR) AS date, target, {CLIPPED.format(c='carried')} AS target_cleaned FROM filled, fences",
)


@query("clean_retail", RETAIL_SQL)
def clean_retail(spark, sf_dir):
    return C.clean_retail(panels.sales_daily(spark, sf_dir), clip=C.ClipRule(by_quartiles=True))


@query(
    "clean_retail_keep_rows",
    with_(
        SEGMENTS,
        """SELECT entity, CAST(date AS VARCHAR) AS date, target, least(greatest(target, 2), 6) AS target_cleaned FROM segments""",
    ),
)
def clean_retail_keep_rows(spark, sf_dir):
    return C.clean_retail(panels.segment_daily(spark, sf_dir), reindex=False, clip=C.ClipRule(lower=2, upper=6))


# ---- store sales -----------------------------------------------------------------------------------

MERGED = 'merged AS (SELECT r.*, "StoreType", "Assortment", "CompetitionDistance" FROM raw_store r LEFT JOIN master m ON r."Store" = m."Store")'
NORMAL = """normal AS (
    SELECT "Date" AS date, "Store" AS store_id, "Sales" AS target_raw, "Sales" AS target_cleaned,
           "Open" <> 0 AS open, "Promo" <> 0 AS promo, "StateHoliday" AS state_holiday, "SchoolHoliday" <> 0 AS school_holiday,
           "StoreType" AS store_type, "Assortment" AS assortment, "CompetitionDistance" AS competition_distance,
           l_orderkey, l_linenumber
    FROM merged)"""
STORE_BASE = (RAW_STORE, MASTER, MERGED, NORMAL)


def _merged(spark, sf_dir):
    return SS.merge_store(panels.raw_store_sales(spark, sf_dir), panels.store_master(spark, sf_dir))


def _normal(spark, sf_dir):
    return SS.normalize_schema(_merged(spark, sf_dir))


@query(
    "merge_store",
    with_(
        RAW_STORE, MASTER, MERGED,
        """SELECT CAST("Date" AS VARCHAR) AS "Date", "Store", "Sales", "Open", "Promo", "StateHoliday", "SchoolHoliday", l_orderkey,
                  l_linenumber, "StoreType", "Assortment", round("CompetitionDistance", 6) AS "CompetitionDistance" FROM merged""",
    ),
)
def merge_store(spark, sf_dir):
    return _merged(spark, sf_dir)


NORMAL_SHOWN = """CAST(date AS VARCHAR) AS date, store_id, target_raw, state_holiday, school_holiday, store_type,
    assortment, round(competition_distance, 6) AS competition_distance, l_orderkey, l_linenumber"""


@query("normalize_schema", with_(*STORE_BASE, f"SELECT {NORMAL_SHOWN}, open, promo, target_cleaned FROM normal"))
def normalize_schema(spark, sf_dir):
    return _normal(spark, sf_dir)


@query(
    "zero_closed_days",
    with_(*STORE_BASE, "SELECT l_orderkey, l_linenumber, open, target_raw, CASE WHEN open THEN target_raw ELSE 0 END AS target_cleaned FROM normal"),
)
def zero_closed_days(spark, sf_dir):
    return SS.zero_closed_days(_normal(spark, sf_dir)).select(*FILE_ORDER, "open", "target_raw", "target_cleaned")


@query(
    "drop_missing_keys",
    with_(
        MASTER,
        """SELECT "Store", "StoreType", round("CompetitionDistance", 6) AS "CompetitionDistance" FROM master
           WHERE "CompetitionDistance" IS NOT NULL AND "StoreType" IS NOT NULL""",
    ),
)
def drop_missing_keys(spark, sf_dir):
    master = panels.store_master(spark, sf_dir).drop("Assortment")
    return SS.drop_missing_keys(master, ("CompetitionDistance", "StoreType"))


MEDIAN = "coalesce((SELECT quantile_cont(competition_distance, 0.5) FROM normal WHERE date IS NOT NULL AND store_id IS NOT NULL), 0)"


@query(
    "median_fill",
    with_(*STORE_BASE, f"SELECT l_orderkey, l_linenumber, store_id, round(coalesce(competition_distance, {MEDIAN}), 6) AS competition_distance FROM normal"),
)
def median_fill(spark, sf_dir):
    filled = SS.median_fill(SS.drop_missing_keys(_normal(spark, sf_dir)))
    return filled.select(*FILE_ORDER, "store_id", "competition_distance")


@query(
    "dedup_keep_first",
    with_(RAW, """SELECT entity, CAST(date AS VARCHAR) AS date, target, l_orderkey, l_linenumber FROM raw """
          + FIRST_ROWS.format(keys="entity, date", order="l_orderkey, l_linenumber")),
)
def dedup_keep_first(spark, sf_dir):
    return C.keep_first(panels.raw_series(spark, sf_dir), ["entity", "date"], FILE_ORDER)


@query(
    "enforce_output_schema",
    with_(*STORE_BASE, f"SELECT {NORMAL_SHOWN}, CAST(open AS BIGINT) AS open, CAST(promo AS BIGINT) AS promo, target_cleaned FROM normal"),
)
def enforce_output_schema(spark, sf_dir):
    return SS.enforce_output_schema(_normal(spark, sf_dir))


STORE_SQL = with_(
    *STORE_BASE,
    f"""SELECT CAST(date AS VARCHAR) AS date, store_id, target_raw, state_holiday, school_holiday, store_type, assortment,
               round(coalesce(competition_distance, {MEDIAN}), 6) AS competition_distance, l_orderkey, l_linenumber,
               CAST(open AS BIGINT) AS open, CAST(promo AS BIGINT) AS promo, CASE WHEN open THEN target_raw ELSE 0 END AS target_cleaned
        FROM normal WHERE date IS NOT NULL AND store_id IS NOT NULL """
    + FIRST_ROWS.format(keys="store_id, date", order="l_orderkey, l_linenumber"),
)


@query("clean_store_sales", STORE_SQL)
def clean_store_sales(spark, sf_dir):
    return SS.clean_store_sales(_normal(spark, sf_dir), FILE_ORDER)


# ---- whole jobs ------------------------------------------------------------------------------------


@query(
    "run_generic",
    with_(
        RAW,
        """SELECT entity, CAST(date AS VARCHAR) AS date, least(target, 40) AS target, l_orderkey, l_linenumber FROM raw """
        + FIRST_ROWS.format(keys="entity, date", order="l_orderkey, l_linenumber"),
    ),
)
def run_generic_job(spark, sf_dir):
    return run_generic(
        panels.raw_series(spark, sf_dir),
        validate={"series": "entity", "max_duplicate_ratio": 1.0},
        cleaning={"upper": 40, "unique_by": ["entity", "date"], "order": FILE_ORDER},
    )


@query("run_retail", RETAIL_SQL)
def run_retail_job(spark, sf_dir):
    return run_retail(panels.sales_daily(spark, sf_dir), cleaning={"clip": C.ClipRule(by_quartiles=True)})


@query("run_store_sales", STORE_SQL)
def run_store_sales_job(spark, sf_dir):
    return run_store_sales(panels.raw_store_sales(spark, sf_dir), panels.store_master(spark, sf_dir), FILE_ORDER)


# ---- augmentation ----------------------------------------------------------------------------------

SEED = 42


def u_sql(*key: str) -> str:
    parts = ", ".join([f"'{SEED}'", *key])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def int_sql(low: str, high: str, *key: str) -> str:
    return f"({low} + CAST(floor({u_sql(*key)} * ({high} - {low})) AS BIGINT))"


def normal_sql(*key: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u_sql(*key, chr(39) + 'r' + chr(39))})) * cos(2 * pi() * {u_sql(*key, chr(39) + 'a' + chr(39))}))"


NOISE_KEY = ("CAST(entity AS VARCHAR)", "CAST(date AS VARCHAR)")


@query(
    "gaussian_noise",
    with_(SEGMENTS, f"SELECT entity, CAST(date AS VARCHAR) AS date, round(target + 2.0 * {normal_sql(*NOISE_KEY)}, 6) AS target FROM segments"),
)
def gaussian_noise(spark, sf_dir):
    return A.gaussian_noise(panels.segment_daily(spark, sf_dir), SEED, noise_std=2.0)


@query(
    "augment",
    with_(
        SALES,
        f"""SELECT entity, CAST(date AS VARCHAR) AS date,
                   round(target + 0.1 * (SELECT stddev_samp(target) FROM sales) * {normal_sql(*NOISE_KEY)}, 6) AS target FROM sales""",
    ),
)
def augment(spark, sf_dir):
    return A.augment(panels.sales_daily(spark, sf_dir), SEED, enabled=True, add_noise=True, noise_scale=0.1)


BLOCKS = A.MissingBlocks(n_blocks=3, size_min=2, size_max=9)
SHIFTS = A.NoiseShift(n_shifts=2, scale_before=0.5, scale_after=3.0)
TRENDS = A.TrendChange(n_windows=2, length_min=20, length_max=60)


def augment_sql(panel_cte: str, panel: str, blocks=None, shifts=None, trends=None) -> str:
    """The draws of each step as SQL, over the positions of each series."""
    who = "CAST(entity AS VARCHAR)"
    value, tags, drawn = "target", [], []
    hits = []
    if blocks:
        for i in range(blocks.n_blocks):
            size = int_sql(str(blocks.size_min), str(blocks.size_max + 1), who, "'block'", f"'{i}'", "'size'")
            drawn.append(f"{size} AS size{i}")
            drawn.append(f"{int_sql('0', f'greatest(1, n - {size} + 1)', who, chr(39) + 'block' + chr(39), f'{chr(39)}{i}{chr(39)}', chr(39) + 'start' + chr(39))} AS block{i}")
            hits.append(f"({i} < greatest(1, n // {max(1, blocks.size_min)}) AND idx >= block{i} AND idx < block{i} + size{i})")
        value = f"CASE WHEN NOT ({' OR '.join(hits)}) THEN target END"
        tags += [f"CASE WHEN {h} THEN 'missing_block' END" for h in hits]
    if shifts:
        cuts = ", ".join(
            f"CASE WHEN {i} < n - 1 THEN {int_sql('1', 'n', who, chr(39) + 'cut' + chr(39), f'{chr(39)}{i}{chr(39)}')} END" for i in range(shifts.n_shifts)
        )
        drawn.append(f"len(list_filter(list_distinct([{cuts}]), lambda c: c <= idx)) AS regime")
        noise = normal_sql(who, "CAST(idx AS VARCHAR)", "'noise'")
        value = f"({value}) + CASE WHEN regime % 2 = 0 THEN {shifts.scale_before} ELSE {shifts.scale_after} END * {noise}"
        tags.append("'noise_shift'")
    later = []
    if trends:
        for i in range(trends.n_windows):
            length = f"least({int_sql(str(trends.length_min), str(trends.length_max + 1), who, chr(39) + 'trend' + chr(39), f'{chr(39)}{i}{chr(39)}', chr(39) + 'length' + chr(39))}, n)"
            drawn.append(f"{length} AS length{i}")
            drawn.append(f"{int_sql('0', f'greatest(1, n - {length} + 1)', who, chr(39) + 'trend' + chr(39), f'{chr(39)}{i}{chr(39)}', chr(39) + 'start' + chr(39))} AS start{i}")
            later.append(f"max(CASE WHEN idx = start{i} THEN date END) OVER (PARTITION BY entity) AS since{i}")
            inside = f"(idx >= start{i} AND idx < start{i} + length{i})"
            slope = f"({trends.slope_min} + {u_sql(who, chr(39) + 'trend' + chr(39), f'{chr(39)}{i}{chr(39)}', chr(39) + 'slope' + chr(39))} * ({trends.slope_max - trends.slope_min}))"
            value = f"({value}) + CASE WHEN {inside} THEN {slope} * (date - since{i}) ELSE 0 END"
            tags.append(f"CASE WHEN {inside} THEN 'trend' END")
    return with_(
        panel_cte,
        f"placed AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY entity) AS n FROM {panel})",
        f"drawn AS (SELECT *, {', '.join(drawn)} FROM placed)",
        f"dated AS (SELECT * {', ' + ', '.join(later) if later else ''} FROM drawn)",
        f"""SELECT entity, CAST(date AS VARCHAR) AS date, target, target AS target_original, round({value}, 6) AS target_augmented,
                   coalesce(nullif(concat_ws(',', {', '.join(tags)}), ''), 'original') AS augmentation_type FROM dated""",
    )


@query("missing_blocks", augment_sql(SEGMENTS, "segments", blocks=BLOCKS))
def missing_blocks(spark, sf_dir):
    return A.augment_timeseries(panels.segment_daily(spark, sf_dir), SEED, missing=BLOCKS)


@query("noise_regime_shift", augment_sql(SEGMENTS, "segments", shifts=SHIFTS))
def noise_regime_shift(spark, sf_dir):
    return A.augment_timeseries(panels.segment_daily(spark, sf_dir), SEED, noise=SHIFTS)


@query("trend_change", augment_sql(SEGMENTS, "segments", trends=TRENDS))
def trend_change(spark, sf_dir):
    return A.augment_timeseries(panels.segment_daily(spark, sf_dir), SEED, trend=TRENDS)


@query("augment_timeseries", augment_sql(SALES, "sales", BLOCKS, SHIFTS, TRENDS))
def augment_timeseries(spark, sf_dir):
    return A.augment_timeseries(panels.sales_daily(spark, sf_dir), SEED, missing=BLOCKS, noise=SHIFTS, trend=TRENDS)
