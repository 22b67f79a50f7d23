"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond". Each step is a groupBy with a
pre-aggregated minimum and an equi-join; nothing is collected but whether all components are stars by now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): links each node's neighbours to the least node it sees."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    out = out.where("u <> v")
    return out if large else out.distinct()  # the small star comes after the large one


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: nothing points twice, and nothing that points is pointed at."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("u").alias("x"), one.alias("out"), none.alias("in")).unionByName(edges.select(F.col("v").alias("x"), none.alias("out"), one.alias("in")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out > 0 AND in > 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): every node of an edge with the least node of its component.

    edges: two columns u, v of one orderable type; self-links and repeats are allowed, nulls are
    ignored. An empty table gives an empty table.
    """
    now = materialize(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        after = materialize(_star(_star(now, True), False), "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
