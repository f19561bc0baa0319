"""Connected components of an edge table by alternating large-star and small-star contraction.

Every step is a grouped minimum and an equi-join with a table of one row per node, so a node with a
third of all edges is pre-aggregated on the map side and split by the adaptive skew join; labels and
edges stay in Spark tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.staging import staged


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", "m")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("k").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 or out > 0 and into > 0").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(node, component): every node that has an edge, with the least node of its component.

    Self edges and nulls are ignored; repeated edges count once; an empty table gives an empty result.
    Each round ends in the shared folder.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v"))
    now = staged(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _are_stars(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = staged(small.filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
