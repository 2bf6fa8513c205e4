"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import _common as c


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for edges (a, b) of integers; component is the least node reachable.

    Each round hooks the neighbours of a node to their least one; stars grow over
    powers of two, so that the rounds grow with the logarithm of the longest path.
    Nodes without an edge aren't returned.
    """
    e = c.stored(edges.filter("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    while True:
        size, total = _state(e)
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").filter("v > u").selectExpr("v AS u", "m AS v").distinct()
        e = c.stored(e.filter("u <> v"))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u")
        e = c.stored(e.selectExpr("v AS u", "m AS v").unionByName(e.selectExpr("u", "m AS v")).filter("u <> v").distinct())
        if _state(e) == (size, total):
            break
    stars = e.groupBy("u").agg(F.min("v").alias("v")).selectExpr("u AS node", "v AS component")
    return stars.unionByName(stars.selectExpr("component AS node", "component").distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
