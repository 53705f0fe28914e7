"""Link heuristics over common neighbours.

All three start from one wedge join of the candidate links with the edges of both ends; the middle node's weight is
joined to the edges beforehand, so a hub's edges are only read where a candidate touches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _summed(links: DataFrame, edges: DataFrame, weights: DataFrame | None, name: str) -> DataFrame:
    a = edges.select(F.col("src"), F.col("dst").alias("mid"), F.col("weight").alias("_a"))
    b = edges.select(F.col("src").alias("dst"), F.col("dst").alias("mid"), F.col("weight").alias("_b"))
    if weights is not None:
        a = a.join(weights.select(F.col("id").alias("mid"), F.col("w").alias("_w")), "mid")
    product = F.col("_a") * F.col("_b") * (F.col("_w") if weights is not None else F.lit(1.0))
    found = links.join(a, "src").join(b, ["dst", "mid"]).groupBy("src", "dst").agg(F.sum(product).alias("_v"))
    return links.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("_v", F.lit(0.0)).cast("double").alias(name))


def _strength(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"))


def common_neighbours(links: DataFrame, edges: DataFrame) -> DataFrame:
    """H03. Sum over shared neighbours of the products of the two edge weights."""
    return _summed(links, edges, None, "score")


def adamic_adar(links: DataFrame, edges: DataFrame) -> DataFrame:
    """H04. The same, each neighbour weighted by 1 / ln(strength); strengths up to 1 count 0."""
    w = _strength(edges).select("id", F.when(F.col("d") > 1, 1 / F.log("d")).otherwise(F.lit(0.0)).alias("w"))
    return _summed(links, edges, w, "score")


def resource_allocation(links: DataFrame, edges: DataFrame) -> DataFrame:
    """H05. The same, each neighbour weighted by 1 / strength."""
    w = _strength(edges).select("id", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(F.lit(0.0)).alias("w"))
    return _summed(links, edges, w, "score")


def two_hop_candidates(edges: DataFrame) -> DataFrame:
    """(src < dst): pairs that share a neighbour and are not linked."""
    a, b = edges.select("src", F.col("dst").alias("mid")), edges.select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").where("src < dst").select("src", "dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
