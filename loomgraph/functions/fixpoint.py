"""Fixpoints over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions.skew import join_by_count
from loomgraph.functions.storage import discard, stash


def _stored(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges written, with their number and a checksum that the write itself has taken."""
    seen = Observation()
    out = stash(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
    got = seen.get
    return out, (got["n"], got["sum"])


def _star(edges: DataFrame, large: bool, total: int) -> tuple[DataFrame, DataFrame]:
    """One star step. ``large``: every larger neighbour is linked to the node's smallest neighbour;
    else every smaller neighbour and the node itself are. ``total`` bounds the number of rows. The second table is the
    stored one that the step reads."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = Observation()
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    low = stash(low.observe(seen, F.max("n").alias("n")), "low")
    linked = join_by_count(both, low, ["u"], total, largest=seen.get["n"] or 0)
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct(), low


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps: rounds grow with the logarithm of the component size, a node's
    smallest neighbour is found by a partially aggregated minimum and joined back with the hubs kept out of the
    shuffle, and no group is gathered anywhere. Nulls take no part, a self loop makes a component of one node,
    repeated edges count once; without edges nothing is iterated.
    """
    base = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    first, state = _stored(base.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if not state[0]:
        return first.select(F.col("u").alias("node"), F.col("v").alias("component"))
    loops = first.where("u = v").select("u")
    cur, old, state = first.where("u <> v"), None, (state[0], None)
    for _ in range(max_rounds):
        total = 2 * state[0]
        step, low = _star(cur, True, total)
        large = stash(step, "large")
        step, low_small = _star(large, False, total)
        new, now = _stored(step, "stars")
        discard(large, low, low_small, *([old] if old is not None else []))
        cur = old = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = cur.select(F.col("v").alias("node")).unionByName(loops.withColumnRenamed("u", "node")).distinct()
    roots = roots.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    out = stash(found.unionByName(roots), "components")
    discard(first, cur)
    return out
