"""Edge tables: (src, dst) with optional weight, type or edge id; a leading graph_id may be carried by ``keys``.

Nulls in src or dst are dropped by the joins as in SQL; self loops and repeated edges are kept unless an operator
says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import ranking
from loomgraph.functions.fixpoint import connected_components  # noqa: F401  (E08)
from loomgraph.functions.skew import join_by_count, spread
from loomgraph.functions.storage import stash


def flipped(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def to_undirected(edges: DataFrame, reduce: str | None = None, total: int = 0) -> DataFrame:
    """E01. Both orientations once each; with ``reduce`` the weights of equal pairs are combined by that aggregate. Where ``total``
    edges at most are many, they are dealt into more partitions."""
    both = spread(edges.unionByName(flipped(edges)), 2 * total, "src", "dst")
    if reduce is None:
        return both.select("src", "dst").distinct()
    return both.groupBy("src", "dst").agg(F.expr(f"{reduce}(weight)").alias("weight"))


def drop_self_loops(edges: DataFrame) -> DataFrame:
    """E02."""
    return edges.where("src <> dst")


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """E02. One loop for each node, whether it had one or not."""
    return drop_self_loops(edges).select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))


def coalesce_edges(edges: DataFrame, how: str = "sum", value: str = "weight") -> DataFrame:
    """E03. One row for each pair."""
    return edges.groupBy("src", "dst").agg(F.expr(f"{how}({value})").alias(value))


def adjacency_list(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """E04. (id, neighbours sorted); isolated nodes have an empty list."""
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
    none = F.array().cast("array<bigint>")
    return nodes.select("id").join(lists, F.col("id") == F.col("src"), "left").select(
        "id", F.coalesce("neighbours", none).alias("neighbours")
    )


def degree(edges: DataFrame, nodes: DataFrame, by: str = "src", weight: str | None = None, cap: int | None = None) -> DataFrame:
    """E05. (id, degree) of every node, capped by its own degree."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    deg = edges.groupBy(F.col(by).alias("_n")).agg(total.alias("_d"))
    value = F.coalesce("_d", F.lit(0))
    return nodes.select("id").join(deg, F.col("id") == F.col("_n"), "left").select(
        "id", (F.least(value, F.lit(cap)) if cap is not None else value).alias("degree")
    )


def dense_ids(keys: DataFrame, key: str = "key", start: int = 0) -> DataFrame:
    """E09. (key, id): contiguous ids in key order."""
    return ranking.global_rank(keys.select(key).distinct(), [F.col(key)], "_r").select(key, (F.col("_r") - 1 + start).alias("id"))


def remap(edges: DataFrame, ids: DataFrame, key: str = "key") -> DataFrame:
    """E09. Edges with both ends replaced by ids; edges with an unmapped end go."""
    a, b = ids.select(F.col(key).alias("src"), F.col("id").alias("_s")), ids.select(F.col(key).alias("dst"), F.col("id").alias("_d"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest)


def induced(edges: DataFrame, subset: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """E06. Edges with both ends in ``subset`` (id [+ keys])."""
    keys = keys or []
    return edges.join(subset.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi").join(
        subset.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi"
    )


def induced_relabelled(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """E06. The same with ids 0..n-1 in id order."""
    return remap(edges, dense_ids(subset.withColumnRenamed("id", "key")))


def class_capped_nodes(nodes: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """E07. (id): the first ``cap`` nodes with an edge of each class, and all their in-neighbours."""
    linked = nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    first = ranking.group_rank(linked, ["label"], [F.col("id")]).where(F.col("rn") <= cap).select("id")
    near = edges.join(first.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return first.unionByName(near).distinct()


def largest_component(edges: DataFrame) -> DataFrame:
    """E08. (id): nodes of the component with most nodes, the smaller name on ties."""
    comps = connected_components(edges)
    top = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return comps.join(F.broadcast(top.select("component")), "component", "left_semi").select(F.col("node").alias("id"))


def with_unknown(triples: DataFrame, entities: DataFrame, text: str = "missing entity") -> DataFrame:
    """E10. Entities plus those that only triples name, with a placeholder text."""
    named = triples.select(F.col("h").alias("entity")).unionByName(triples.select(F.col("t").alias("entity"))).distinct()
    return entities.select("entity", "text").unionByName(
        named.join(entities, "entity", "left_anti").select("entity", F.lit(text).alias("text"))
    )


def with_inverse(edges: DataFrame, relations: int) -> DataFrame:
    """E11. Edges and their reverses, whose type is shifted by the number of relations."""
    return edges.select("src", "dst", "type").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("type") + relations).alias("type"))
    )


def flatten_relations(relations: dict[int, DataFrame]) -> DataFrame:
    """E12. One typed edge table from an edge table for each relation."""
    parts = [df.select("src", "dst", F.lit(t).alias("type")) for t, df in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Nodes of a key from which it counts as wide, and rows of a block of a wide key.
WIDE, BLOCK = 1_000, 1_000


def bipartite_projection(links: DataFrame, key: str, node: str, min_shared: int = 1, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """E13. (src < dst, weight): nodes that share at least ``min_shared`` keys, and how many.

    Pairs inside narrow keys are made and counted at once. Wide keys, of more than ``wide`` nodes, make few pairs: two nodes
    that share no narrow key need ``min_shared`` wide ones, so all but the ``min_shared - 1`` widest keys of each node can
    find them, and only pairs found so, or by a narrow key, are looked up in the wide keys. What makes pairs of a wide
    key is dealt as pairs of blocks, so no task has more than about ``block`` x ``block`` of them. With ``min_shared`` 1 every pair
    of a wide key is in the result."""
    told = links.select(F.col(key).alias("_k"), F.col(node).alias("_n")).where("_k is not null and _n is not null")
    one = stash(spread(told, links.count(), "_k").distinct(), "members")
    pairs = lambda rows: rows.withColumnRenamed("_n", "src").join(rows.withColumnRenamed("_n", "dst"), "_k").where("src < dst")
    sizes = one.groupBy("_k").agg(F.count(F.lit(1)).alias("_c"))
    of = F.col("_c") * (F.col("_c") - 1) / 2
    seen = sizes.agg(F.max("_c").alias("m"), F.sum(F.when(F.col("_c") <= wide, of)).alias("made")).first()
    widest, made = seen["m"] or 0, int(seen["made"] or 0)
    # a task makes and counts a bounded number of pairs
    dealt_pairs = lambda rows: spread(pairs(spread(rows, made, "_k")), made, "src", "dst")
    if widest <= wide:
        counted = dealt_pairs(one).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
        return counted.where(F.col("weight") >= min_shared) if min_shared > 1 else counted
    wides = stash(sizes.where(F.col("_c") > wide), "wide")  # a key for each ``wide`` rows at most
    total = one.count()
    narrow = one.join(wides.select("_k"), "_k", "left_anti")
    members = stash(join_by_count(one, wides.withColumn("n", F.col("_c")), ["_k"], total, largest=widest), "wide_members")
    counted = dealt_pairs(narrow).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_w"))
    # each node's wide keys but its widest few
    rank = F.row_number().over(Window.partitionBy("_n").orderBy(F.desc("_c"), F.desc("_k")))
    makers = stash(members.withColumn("_r", rank).where(F.col("_r") >= min_shared).select("_k", "_n"), "makers")
    left = makers.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.ceil(F.col("n") / block).cast("int"))
    dealt = join_by_count(makers, left, ["_k"], total, largest=widest).withColumn("_i", F.pmod(F.xxhash64("_n"), F.col("_b")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    met = dealt.select("_k", F.col("_n").alias("src"), F.col("_i").alias("_x"), others.alias("_y")).join(
        dealt.select("_k", F.col("_n").alias("dst"), F.col("_i").alias("_y"), others.alias("_x")), ["_k", "_x", "_y"]).where("src < dst")
    found = stash(counted.unionByName(met.select("src", "dst").distinct().withColumn("_w", F.lit(0).cast("long"))).groupBy("src", "dst").agg(F.sum("_w").alias("_w")), "candidates")
    also = found.select("src", "dst").join(members.select(F.col("_n").alias("src"), "_k"), "src").join(members.select(F.col("_n").alias("dst"), "_k"), ["dst", "_k"])
    extra = also.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_e"))
    out = found.join(extra, ["src", "dst"], "left").select("src", "dst", (F.col("_w") + F.coalesce("_e", F.lit(0))).alias("weight"))
    return out.where(F.col("weight") >= min_shared)


def year_filtered(edges: DataFrame, year: int) -> DataFrame:
    """E14. Undirected edges of ``year`` or later, weights of parallel ones summed."""
    return to_undirected(edges.where(F.col("year") >= year).select("src", "dst", "weight"), "sum")


def canonical(a: str = "src", b: str = "dst") -> list[Column]:
    return [F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")]


def without_links(edges: DataFrame, held: DataFrame) -> DataFrame:
    """E15. Edges without the held-out pairs in either orientation, symmetric again."""
    gone = held.select(*canonical()).distinct()
    kept = edges.select(*canonical()).distinct().join(gone, ["_lo", "_hi"], "left_anti")
    return to_undirected(kept.select(F.col("_lo").alias("src"), F.col("_hi").alias("dst")))


def without_target(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """E16. Per sample the edges other than its target pair, in either orientation."""
    gone = targets.select("sample_id", *canonical())
    return samples.withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")}).join(
        gone, ["sample_id", "_lo", "_hi"], "left_anti"
    ).drop("_lo", "_hi")


def message_edges(edges: DataFrame, splits: DataFrame, stages: list[str]) -> DataFrame:
    """E17. Edges whose split is one of ``stages``."""
    return edges.join(splits.where(F.col("split").isin(stages)), "edge_id", "left_semi")


def signed_bidirectional(edges: DataFrame) -> DataFrame:
    """E18. Each edge and its reverse, whose id is -1 - id and whose direction is 1."""
    return edges.select("src", "dst", "edge_id", F.lit(0).alias("direction")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-1 - F.col("edge_id")).alias("edge_id"), F.lit(1).alias("direction"))
    )


def offsets(counts: DataFrame, group: str = "g", n: str = "n") -> DataFrame:
    """E19. (g, n, start) of ragged rows in group order. The window runs over one row for each group."""
    run = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(group, n, F.coalesce(F.sum(n).over(run), F.lit(0)).alias("start"))


def ragged_index(counts: DataFrame, group: str = "g", n: str = "n") -> DataFrame:
    """E19. (g, pos) for each of a group's n elements."""
    return counts.where(F.col(n) > 0).select(group, F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias("pos"))


def set_algebra(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """E20. union, difference, intersection or symmetric difference of two id sets."""
    a, b = a.select("id"), b.select("id")
    if how == "union":
        return a.unionByName(b).distinct()
    if how == "intersection":
        return a.intersect(b)
    if how == "difference":
        return a.subtract(b)
    return a.subtract(b).unionByName(b.subtract(a))


def keep_attributes(df: DataFrame, names: list[str]) -> DataFrame:
    """E21. Those of the named columns that are there, in the order of the table."""
    return df.select(*[c for c in df.columns if c in names])


def degree_as_feature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """E22. (id, x) with the degree appended."""
    return nodes.join(degree(edges, nodes), "id").select("id", F.concat("x", F.array(F.col("degree").cast("double"))).alias("x"))


def consecutive_runs(values: DataFrame, group: str, value: str) -> DataFrame:
    """E23. (group, first, last, n) of each run of consecutive integers."""
    own = Window.partitionBy(group).orderBy(value)
    runs = values.select(group, value).distinct().withColumn("_run", F.col(value) - F.row_number().over(own))
    return runs.groupBy(group, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")
