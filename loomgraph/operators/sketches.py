"""Structural counts of a link's neighbourhood: exact sets as the twin of the sketches, and DataSketches estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ranking import md5_key


def structure_counts(distances: DataFrame, hops: int) -> DataFrame:
    """K07, exact. (src, dst, n_i_j): nodes at distance i from src and j from dst; n_i_0 and n_0_j count nodes within
    no hop of the other end. Input rows are (src, dst, node, ds, dd) with null beyond ``hops``; the ends are left out."""
    inner = distances.where("node <> src and node <> dst")
    cells = [(i, j) for i in range(1, hops + 1) for j in range(1, hops + 1)] + [(i, 0) for i in range(1, hops + 1)] + [(0, j) for j in range(1, hops + 1)]
    is_at = lambda c, k: F.col(c).isNull() if k == 0 else F.col(c) == k
    return inner.groupBy("src", "dst").agg(*[F.count_if(is_at("ds", i) & is_at("dd", j)).alias(f"n_{i}_{j}") for i, j in cells])


def hll_neighbourhoods(edges: DataFrame, nodes: DataFrame, hops: int, lg: int = 10) -> DataFrame:
    """K02, K03. (id, hop, sketch): HLL sketches of the nodes within each number of hops, the node itself included."""
    own = nodes.select("id", F.lit(0).alias("hop"), F.col("id").alias("_v")).groupBy("id", "hop").agg(F.hll_sketch_agg("_v", lg).alias("sketch"))
    out = cur = own
    for h in range(1, hops + 1):
        near = edges.select(F.col("src").alias("id"), "dst").join(cur.select(F.col("id").alias("dst"), "sketch"), "dst").select("id", "sketch")
        cur = near.unionByName(cur.select("id", "sketch")).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch")).select("id", F.lit(h).alias("hop"), "sketch")
        out = out.unionByName(cur)
    return out


def hll_counts(sketches: DataFrame) -> DataFrame:
    """K04. Estimated sizes."""
    return sketches.select("id", "hop", F.hll_sketch_estimate("sketch").alias("n"))


def minhash(nodes: DataFrame, slots: int, portable: bool = False) -> DataFrame:
    """K01. (id, slot, h): one hash of each node for each slot; ``portable`` takes it from md5, which other engines
    have too, at a higher price."""
    h = F.conv(F.substring(md5_key("slot", "id", "slot"), 1, 15), 16, 10).cast("long") if portable else F.xxhash64("id", "slot")
    return nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).withColumn("h", h)


def minhash_propagate(hashes: DataFrame, edges: DataFrame) -> DataFrame:
    """K03. Slot-wise minimum over a node and its neighbours."""
    near = edges.select(F.col("src").alias("id"), "dst").join(hashes.withColumnRenamed("id", "dst"), "dst").select("id", "slot", "h")
    return near.unionByName(hashes.select("id", "slot", "h")).groupBy("id", "slot").agg(F.min("h").alias("h"))


def minhash_jaccard(links: DataFrame, hashes: DataFrame, slots: int) -> DataFrame:
    """K05. (src, dst, jaccard): share of equal slots."""
    a, b = hashes.select(F.col("id").alias("src"), "slot", F.col("h").alias("_a")), hashes.select(F.col("id").alias("dst"), "slot", F.col("h").alias("_b"))
    return links.join(a, "src").join(b, ["dst", "slot"]).groupBy("src", "dst").agg((F.count_if(F.col("_a") == F.col("_b")) / slots).alias("jaccard"))


def minhash_neighbourhoods(hashes: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """K03. (id, hop, slot, h): slot-wise minima over the nodes within each number of hops, from 0."""
    cur, out = hashes, hashes.select("id", F.lit(0).alias("hop"), "slot", "h")
    for h in range(1, hops + 1):
        cur = minhash_propagate(cur, edges)
        out = out.unionByName(cur.select("id", F.lit(h).alias("hop"), "slot", "h"))
    return out


def intersections(links: DataFrame, hashes: DataFrame, sketches: DataFrame, slots: int) -> DataFrame:
    """K06. (src, dst, k1, k2, n) for every two hops but 0: jaccard of the balls of src and dst times the estimated size
    of their union, from hashes (id, hop, slot, h) and sketches (id, hop, sketch)."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("slot", "h"))), lambda x: x["h"])  # one element for each slot
    both = hashes.where("hop > 0").groupBy("id", "hop").agg(row.alias("h")).join(sketches, ["id", "hop"])
    end = lambda c, k: both.select(F.col("id").alias(c), F.col("hop").alias(k), F.col("h").alias(f"_h{k}"), F.col("sketch").alias(f"_s{k}"))
    same = F.size(F.filter(F.zip_with("_hk1", "_hk2", lambda x, y: x == y), lambda x: x)) / slots
    return links.join(end("src", "k1"), "src").join(end("dst", "k2"), "dst").select("src", "dst", "k1", "k2", (same * F.hll_sketch_estimate(F.hll_union("_sk1", "_sk2"))).alias("n"))


def cells(hops: int) -> list[tuple[int, int]]:
    """The (i, j) of the structure features in the usual order: 3, 8 or 15 of them."""
    both = {1: [(1, 1)], 2: [(1, 1), (2, 1), (1, 2), (2, 2)], 3: [(1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3), (3, 2), (2, 3), (3, 3)]}[hops]
    return both + [c for k in range(1, hops + 1) for c in ((0, k), (k, 0))]


def sketch_features(links: DataFrame, hashes: DataFrame, sketches: DataFrame, slots: int, hops: int, zero_one: bool = True, floor: bool = False) -> DataFrame:
    """K07 from sketches. (src, dst, n_i_j): estimated nodes at distance i from src and j from dst, n_0_j those at j from dst
    and farther than ``hops`` from src, by inclusion and exclusion over the intersections of K06 and the sizes of K04; both
    ends count as near themselves. ``zero_one`` off sets what a linked pair cannot have to 0: n_0_1 and n_1_0 from two hops,
    n_0_2 and n_2_0 too from three. ``floor`` sets negative estimates to 0. A link of an unknown node has no row."""
    met = intersections(links.select("src", "dst").distinct(), hashes.where(F.col("hop") <= hops), sketches.where(F.col("hop") <= hops), slots)
    inter = met.groupBy("src", "dst").agg(*[F.max(F.when((F.col("k1") == i) & (F.col("k2") == j), F.col("n"))).alias(f"_i{i}{j}") for i in range(1, hops + 1) for j in range(1, hops + 1)])
    sizes = hll_counts(sketches.where((F.col("hop") > 0) & (F.col("hop") <= hops))).groupBy("id").agg(*[F.max(F.when(F.col("hop") == k, F.col("n"))).cast("double").alias(f"c{k}") for k in range(1, hops + 1)])
    a = sizes.select(F.col("id").alias("src"), *[F.col(f"c{k}").alias(f"_a{k}") for k in range(1, hops + 1)])
    b = sizes.select(F.col("id").alias("dst"), *[F.col(f"c{k}").alias(f"_b{k}") for k in range(1, hops + 1)])
    ball = lambda i, j: F.col(f"_i{i}{j}") if i and j else F.lit(0.0)
    size = lambda c, k: F.col(f"_{c}{k}") if k else F.lit(0.0)

    def cell(i: int, j: int) -> Column:
        if i and j:
            v = ball(i, j) - ball(i - 1, j) - ball(i, j - 1) + ball(i - 1, j - 1)
        elif j:
            v = size("b", j) - size("b", j - 1) - ball(hops, j) + ball(hops, j - 1)
        else:
            v = size("a", i) - size("a", i - 1) - ball(i, hops) + ball(i - 1, hops)
        if not zero_one and 0 in (i, j) and hops > 1 and max(i, j) < hops:
            v = F.lit(0.0)
        return F.greatest(v, F.lit(0.0)) if floor else v

    return inter.join(a, "src").join(b, "dst").select("src", "dst", *[cell(i, j).alias(f"n_{i}_{j}") for i, j in cells(hops)])


def degree_normalised(counts: DataFrame, degrees: DataFrame, names: list[str]) -> DataFrame:
    """K08. Each count over the root of the product of both degrees, 0 where that is 0, next to the counts."""
    a, b = degrees.select(F.col("id").alias("src"), F.col("degree").alias("_a")), degrees.select(F.col("id").alias("dst"), F.col("degree").alias("_b"))

    def scaled(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c), F.sqrt(F.col("_a") * F.col("_b"))), F.lit(0.0))

    return counts.join(a, "src").join(b, "dst").withColumns({f"{c}_norm": scaled(c) for c in names}).drop("_a", "_b")
