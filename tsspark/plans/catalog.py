"""Registry of named queries with their reference SQL, and shared SQL fragments.

A query takes (spark, sf_dir) and returns a DataFrame. ``present`` makes results comparable: days as text
and doubles to a few digits, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query, with SQL over the same tables where SQL can express it."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(build(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return register


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string").alias(f.name)
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits).alias(f.name)
        shown.append(c)
    return df.select(*shown)


def with_(*parts: str) -> str:
    """``WITH a, b, c SELECT ...`` from CTE texts and a final select."""
    *ctes, final = parts
    return f"WITH {', '.join(ctes)} {final}"


SALES = """sales AS (
    SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS target
    FROM lineitem GROUP BY 1, 2)"""
SEGMENTS = """segments AS (
    SELECT c_mktsegment AS entity, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS target
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
EVENTS = """daily_events AS (
    SELECT event_type AS entity, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS target
    FROM events GROUP BY 1, 2)"""
MASTER = """master AS (
    SELECT s_suppkey AS "Store", n_name AS "StoreType", CAST(n_regionkey AS VARCHAR) AS "Assortment",
           CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS "CompetitionDistance"
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
RAW_STORE = """raw_store AS (
    SELECT CAST(l_shipdate AS DATE) AS "Date", l_suppkey AS "Store", l_quantity AS "Sales",
           CASE WHEN isodow(l_shipdate) = 7 THEN 0 ELSE 1 END AS "Open",
           CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS "Promo",
           l_returnflag AS "StateHoliday",
           CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS "SchoolHoliday",
           l_orderkey, l_linenumber
    FROM lineitem)"""
RAW = """raw AS (
    SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, l_quantity AS target, l_orderkey, l_linenumber
    FROM lineitem)"""


def pairs_cte(panel: str, season: int = 7, name: str = "pairs") -> str:
    return f"""{name} AS (
    SELECT * FROM (SELECT entity, date, target AS y_true,
                          lag(target, {season}) OVER (PARTITION BY entity ORDER BY date) AS y_pred FROM {panel})
    WHERE y_pred IS NOT NULL)"""


def naive_cte(panel: str, horizon: int, k: int = 7, name: str = "naive") -> str:
    return f"""{name} AS (
    SELECT b.entity AS entity_id, b.last_date + CAST(h.step AS INTEGER) AS date, b.target AS y_pred,
           'seasonal_naive' AS model_name, CAST(h.step AS INTEGER) AS step
    FROM (SELECT entity, target, max(date) OVER (PARTITION BY entity) AS last_date,
                 row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back,
                 count(*) OVER (PARTITION BY entity) AS n FROM {panel}) b
    JOIN (SELECT unnest(range(1, {horizon + 1})) AS step) h ON b.back = {k} - (h.step - 1) % {k}
    WHERE b.n >= {k})"""


def cutoff_cte(panel: str, share_left: float = 0.8, name: str = "cut") -> str:
    return f"""{name} AS (
    SELECT date AS cutoff FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
                                FROM (SELECT DISTINCT date FROM {panel}))
    WHERE i = floor(n * CAST({share_left} AS DOUBLE)))"""


MAE_SQL = "avg(abs(y_true - y_pred))"
RMSE_SQL = "sqrt(avg((y_true - y_pred) * (y_true - y_pred)))"
MAPE_SQL = "avg(CASE WHEN abs(y_true) > 1e-10 THEN abs((y_true - y_pred) / y_true) END) * 100"
THREE_SQL = f"round({MAE_SQL}, 6) AS mae, round({RMSE_SQL}, 6) AS rmse, round({MAPE_SQL}, 6) AS mape"
