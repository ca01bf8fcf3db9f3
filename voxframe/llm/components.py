"""Connected components of an edge table by alternating star contraction.

Every step is a grouped minimum and an equi-join; edges and minima are written
to the shared folder between steps, so both sides of each join are scans that
Spark shuffles itself and splits where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import staged


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined_minima(edges: DataFrame, minima: DataFrame) -> DataFrame:
    m = staged(minima, "cc-min").withColumnRenamed("u", "_u")
    return edges.join(m, edges["u"] == m["_u"]).drop("_u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(u, v)``; the root is the least
    node reachable. Self-loops and repeated edges are allowed, nulls are not.

    Large-star links each node's larger neighbours to the least one around it,
    small-star links a node and its smaller neighbours to the least of them;
    both keep components and end in one star per component.
    """
    e = staged(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _joined_minima(both, around).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "cc-large")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined_minima(large, below)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        e = staged(small.distinct(), "cc-edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
