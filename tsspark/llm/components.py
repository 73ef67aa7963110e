"""Connected components by repeated contraction; nothing is collected and no node gathers its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component); every node of an edge appears once, components are named by a node.

    In each round every node joins its neighbour of least rank, itself included; ranks are drawn anew per
    round from a hash, so long paths shrink by a constant share as well. Merged nodes become one, edges inside
    are dropped, and the rounds end when no edge is left. A hub's neighbours meet in a grouped minimum, which
    Spark combines before the shuffle. Loops and repeated edges are harmless; no edges give no rows.
    """
    spark = edges.sparkSession
    left = stored(edges.where("a <> b").distinct(), "edges")
    label = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node"))
    turn = 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("other"))
        into = best.select(F.col("a").alias("old"), F.least(rank("a"), F.col("other"))["node"].alias("new"))
        into = stored(into, "into")
        label = label.join(into, label["component"] == into["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
        label = stored(label, "labels")
        a = left.join(into, left["a"] == into["old"]).select(F.col("new").alias("x"), "b")
        moved = a.join(into, a["b"] == into["old"]).select(F.least("x", "new").alias("a"), F.greatest("x", "new").alias("b"))
        left = stored(moved.where("a <> b").distinct(), "edges")
        turn += 1
    return label if turn else spark.createDataFrame([], label.schema)
