"""Connected components of undirected links, each named by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.sources.staging import stage

#: Rounds after which something is wrong: they grow with the logarithm of the number of nodes.
MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another, by alternating large and small stars.

    In each round every node is linked to the smallest node around it, first its larger neighbours, then its
    smaller ones, until the links form stars around the smallest nodes. Each round's links are written out.
    Null ends and links of a node to itself count for nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u <> v")
    edges = stage(edges.distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("inline(array(struct(v AS u, m AS v), struct(u AS u, m AS v)))").where("u <> v")
        edges = stage(small.distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
