"""Registered queries: drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsspark.operators import drift as D
from tsspark.operators.ordered import half_split as split_halves
from tsspark.plans.catalog import SALES, query, with_
from tsspark.plans.catalog_etl import STORE_SQL, clean_store_sales
from tsspark.plans.catalog_models import _sales
from tsspark.sources import panels

FEATURES = ("target", "n_lines", "top_line")


def sales_measures(spark, sf_dir):
    """Daily sales with two more whole-valued measures."""
    lines = panels.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("target"), F.count(F.lit(1)).cast("double").alias("n_lines"), F.max("l_linenumber").cast("double").alias("top_line")
    )


def _long(spark, sf_dir):
    return D.long_form(split_halves(sales_measures(spark, sf_dir)), FEATURES)


MEASURES = """measures AS (
    SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS target,
           CAST(count(*) AS DOUBLE) AS n_lines, CAST(max(l_linenumber) AS DOUBLE) AS top_line FROM lineitem GROUP BY 1, 2)"""


def halves_cte(panel: str) -> str:
    return f"""halves AS (
    SELECT *, CASE WHEN row_number() OVER (ORDER BY date, md5(CAST(entity AS VARCHAR))) <= count(*) OVER () // 2
              THEN 'reference' ELSE 'current' END AS half FROM {panel})"""


LONG = "long AS (" + " UNION ALL ".join(f"SELECT half, '{f}' AS feature, {f} AS value FROM halves" for f in FEATURES) + ")"
BASE = (MEASURES, halves_cte("measures"), LONG)
EDGES = """edges AS (
    SELECT feature, i, CASE WHEN i = 10 THEN high + 1e-10 ELSE low + i * ((high - low) / 10) END AS edge
    FROM (SELECT feature, min(value) AS low, max(value) AS high FROM long WHERE half = 'reference' GROUP BY feature),
         (SELECT unnest(range(0, 11)) AS i))"""
BINS = """bins AS (
    SELECT half, feature, bin, count(*) AS n FROM (
        SELECT half, l.feature, value, least(len(list_filter(es, lambda e: e <= value)), 10) AS bin, es
        FROM long l JOIN (SELECT feature, list(edge ORDER BY i) AS es FROM edges GROUP BY feature) e ON e.feature = l.feature)
    WHERE value >= es[1] AND value <= es[11] GROUP BY 1, 2, 3)"""
SCORES = """scores AS (
    SELECT feature, sum(abs(cur / (all_cur + 1e-10) - ref / (all_ref + 1e-10))) AS score FROM (
        SELECT feature, bin, ref, cur, sum(ref) OVER (PARTITION BY feature) AS all_ref, sum(cur) OVER (PARTITION BY feature) AS all_cur FROM (
            SELECT feature, bin, sum(CASE WHEN half = 'reference' THEN n ELSE 0 END) AS ref,
                   sum(CASE WHEN half = 'current' THEN n ELSE 0 END) AS cur FROM bins GROUP BY 1, 2))
    GROUP BY feature)"""
DRIFT = (*BASE, EDGES, BINS, SCORES)


@query("drift_fit_reference", with_(*BASE, EDGES, "SELECT feature, i, round(edge, 6) AS edge FROM edges"))
def drift_fit_reference(spark, sf_dir):
    edges = D.fit_edges(_long(spark, sf_dir), within=F.col("half") == "reference")
    return edges.select("feature", F.posexplode("edges").alias("i", "edge"))


@query("histogram", with_(*BASE, EDGES, BINS, "SELECT half, feature, bin, n FROM bins"))
def histogram(spark, sf_dir):
    long = _long(spark, sf_dir)
    return D.histogram(long, D.fit_edges(long, within=F.col("half") == "reference"), by=("half",))


@query("drift_score", with_(*DRIFT, "SELECT feature, round(score, 6) AS score FROM scores"))
def drift_score(spark, sf_dir):
    return D.drift_scores(_long(spark, sf_dir))


@query("half_split", with_(SALES, halves_cte("sales"), "SELECT entity, CAST(date AS VARCHAR) AS date, target, half FROM halves"))
def half_split(spark, sf_dir):
    return split_halves(_sales(spark, sf_dir))


OVERALL = """overall AS (SELECT avg(score) AS overall_score, avg(score) > 0.25 AS drift_detected, CAST(0.25 AS DOUBLE) AS threshold FROM scores)"""


@query(
    "feature_drift",
    with_(*DRIFT, OVERALL,
          """SELECT drift_detected, round(overall_score, 6) AS overall_score, threshold, n // 2 AS ref_sample_size, n - n // 2 AS current_sample_size,
                    feature, round(score, 6) AS score FROM overall, scores, (SELECT count(*) AS n FROM measures)"""),
)
def feature_drift(spark, sf_dir):
    found = D.feature_drift(sales_measures(spark, sf_dir))
    return found.select(
        "drift_detected", "overall_score", "threshold", "ref_sample_size", "current_sample_size",
        F.explode("per_feature_scores").alias("feature", "score"),
    )


@query(
    "feature_drift_empty_column",
    with_(*DRIFT, """padded AS (SELECT feature, score FROM scores UNION ALL SELECT 'nothing', 0.0)""",
          """SELECT round(avg(score) OVER (), 6) AS overall_score, feature, round(score, 6) AS score FROM padded"""),
)
def feature_drift_empty_column(spark, sf_dir):
    """A column without values scores 0 and counts in the mean."""
    found = D.feature_drift(sales_measures(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double")))
    return found.select("overall_score", F.explode("per_feature_scores").alias("feature", "score"))


MOVES = """moves AS (
    SELECT feature, (least(abs(mc - mr) / (abs(mr) + 1e-9), 1) + least(abs(sc - sr) / (sr + 1e-9), 1)) / 2 AS mean_std FROM (
        SELECT feature, avg(value) FILTER (half = 'reference') AS mr, avg(value) FILTER (half = 'current') AS mc,
               stddev_samp(value) FILTER (half = 'reference') AS sr, stddev_samp(value) FILTER (half = 'current') AS sc FROM long GROUP BY feature))"""
KS = """distances AS (
    SELECT feature, max(abs(r_upto / r_all - c_upto / c_all)) AS ks FROM (
        SELECT feature, sum(r) OVER w AS r_upto, sum(c) OVER w AS c_upto, sum(r) OVER (PARTITION BY feature) AS r_all, sum(c) OVER (PARTITION BY feature) AS c_all
        FROM (SELECT feature, value, count(*) FILTER (half = 'reference') AS r, count(*) FILTER (half = 'current') AS c FROM long GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY feature ORDER BY value))
    GROUP BY feature)"""


@query("mean_std_drift", with_(*BASE, MOVES, "SELECT feature, round(mean_std, 6) AS mean_std FROM moves"))
def mean_std_drift(spark, sf_dir):
    return D.mean_std_drift(_long(spark, sf_dir))


@query("ks_statistic", with_(*BASE, KS, "SELECT feature, round(ks, 6) AS ks FROM distances"))
def ks_statistic(spark, sf_dir):
    return D.ks_statistic(_long(spark, sf_dir))


STATUS = "CASE WHEN score < 1.0 / 3.0 THEN 'low' WHEN score < 2.0 / 3.0 THEN 'medium' ELSE 'high' END"


@query(
    "distribution_drift",
    with_(
        SALES, halves_cte("sales"), "long AS (SELECT half, 'target' AS feature, target AS value FROM halves)", MOVES, KS,
        f"""SELECT round(score, 6) AS drift_score, {STATUS} AS status, true AS ks_used, n_features FROM (
            SELECT least(greatest(0.5 * avg(mean_std) + 0.5 * avg(ks), 0), 1) AS score, count(*) AS n_features
            FROM moves m JOIN distances d ON m.feature = d.feature)""",
    ),
)
def distribution_drift(spark, sf_dir):
    return D.distribution_drift(_sales(spark, sf_dir))


@query(
    "distribution_drift_empty_column",
    with_(
        MEASURES, halves_cte("measures"), "long AS (SELECT half, 'target' AS feature, target AS value FROM halves)", MOVES, KS,
        f"""SELECT round(score, 6) AS drift_score, {STATUS} AS status, true AS ks_used, 2 AS n_features FROM (
            SELECT 0.5 * (sum(mean_std) / 2) + 0.5 * avg(ks) AS score FROM moves m JOIN distances d ON m.feature = d.feature)""",
    ),
)
def distribution_drift_empty_column(spark, sf_dir):
    panel = sales_measures(spark, sf_dir).select("entity", "date", "target", F.lit(None).cast("double").alias("Customers"))
    return D.distribution_drift(panel)


ENTITY_DRIFT = (
    """series_halves AS (
        SELECT *, CASE WHEN rn <= n // 2 THEN 'reference' ELSE 'current' END AS half FROM (
            SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM sales) WHERE n // 2 >= 20)""",
    "long AS (SELECT half, entity AS feature, target AS value FROM series_halves)",
    MOVES,
    KS,
    """entity_drift AS (SELECT m.feature AS entity, least(greatest(0.5 * mean_std + 0.5 * ks, 0), 1) AS score
                        FROM moves m JOIN distances d ON m.feature = d.feature)""",
)


@query(
    "distribution_drift_by_entity",
    with_(
        SALES, *ENTITY_DRIFT,
        f"""SELECT entity, round(score, 6) AS drift_score, {STATUS} AS status, true AS ks_used, 1 AS n_features FROM entity_drift
            UNION ALL SELECT entity, NULL, 'not_enough_rows', false, 1 FROM sales GROUP BY entity HAVING count(*) // 2 < 20""",
    ),
)
def distribution_drift_by_entity(spark, sf_dir):
    return D.distribution_drift_by_entity(_sales(spark, sf_dir))


PICKED = ("target_raw", "open", "promo", "school_holiday", "competition_distance", "l_orderkey", "l_linenumber")


@query(
    "numeric_column_pick",
    f"SELECT * FROM (SELECT count(*) AS n FROM ({STORE_SQL})), (SELECT unnest({list(PICKED)}) AS feature "
    "UNION ALL SELECT 'target_cleaned')",
)
def numeric_column_pick(spark, sf_dir):
    """The preferred column where it exists, else the numeric ones; with the values each one has."""
    table = clean_store_sales(spark, sf_dir)
    preferred = D.numeric_columns(table.schema)
    others = D.numeric_columns(table.drop("target_cleaned").schema)
    counted = D.long_form(table, [*preferred, *others], ids=("store_id",))
    return counted.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("drift_indicators", with_(*DRIFT, "SELECT feature, round(score, 6) AS score FROM scores WHERE score > 0.02"))
def drift_indicators(spark, sf_dir):
    return D.drift_indicators(D.drift_scores(_long(spark, sf_dir)), 0.02)
