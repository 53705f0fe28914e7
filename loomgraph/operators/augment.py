"""Graph augmentation and prompt graphs, for many graphs at once: tables carry a leading graph_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ranking import group_rank, md5_bucket, md5_key, rank_for, wide_group_rank
from loomgraph.operators.edges import induced


def _ranked(rows: DataFrame, group: list[str], order: list, rank=wide_group_rank) -> DataFrame:
    """Rows with their number ``rn`` in the group and the group's size ``_n``; a group may hold most rows, unless ``rank`` is for narrow ones."""
    if rank is group_rank:
        known = rows.dropna(subset=group)
        return group_rank(known, group, order).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return wide_group_rank(rows, group, order).join(sizes, group)


def _dropped(nodes: DataFrame, share: float, seed, rank=wide_group_rank) -> DataFrame:
    ranked = _ranked(nodes, ["graph_id"], [md5_key(seed, "graph_id", "id"), F.col("id")], rank)
    return ranked.withColumn("drop", F.col("rn") <= F.floor(F.col("_n") * share)).drop("rn", "_n")


def drop_nodes(nodes: DataFrame, edges: DataFrame, share: float, seed=0) -> tuple[DataFrame, DataFrame]:
    """G01. A seeded share of each graph's nodes and all their edges go."""
    kept = _dropped(nodes, share, seed).where(~F.col("drop")).drop("drop")
    return kept, induced(edges, kept.select("graph_id", "id"), ["graph_id"])


def drop_edges(edges: DataFrame, share: float, seed=0) -> DataFrame:
    """G02. A seeded share of each graph's edges goes."""
    ranked = _ranked(edges, ["graph_id"], [md5_key(seed, "graph_id", "src", "dst"), F.col("src"), F.col("dst")])
    return ranked.where(F.col("rn") > F.floor(F.col("_n") * share)).drop("rn", "_n")


def mask_features(nodes: DataFrame, share: float, seed=0) -> DataFrame:
    """G04. A seeded share of each graph's nodes gets the zero vector; ``mask`` tells which."""
    zero = F.transform("x", lambda v: F.lit(0.0))
    return _dropped(nodes, share, seed).withColumn("x", F.when(F.col("drop"), zero).otherwise(F.col("x"))).withColumnRenamed("drop", "mask")


def drop_dimensions(nodes: DataFrame, width: int, percent: int, seed=0) -> DataFrame:
    """G06. The same seeded dimensions are zero for all nodes."""
    on = F.array(*[(md5_bucket(f"{seed}-{i}", buckets=100) >= percent) for i in range(width)])
    return nodes.withColumn("x", F.transform("x", lambda v, i: F.when(on[i], v).otherwise(F.lit(0.0))))


def shuffle_features(nodes: DataFrame, seed=0, rank=wide_group_rank) -> DataFrame:
    """G07. Vectors permuted among the nodes of each graph."""
    own = rank(nodes, ["graph_id"], [F.col("id")]).select("graph_id", "id", "rn")
    other = rank(nodes, ["graph_id"], [md5_key(seed, "graph_id", "id"), F.col("id")]).select("graph_id", "rn", "x")
    return own.join(other, ["graph_id", "rn"]).drop("rn")


def prompted_graph(nodes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G11. For each graph a task node after its n nodes and a class node for each class after that, with typed edges:
    node to task f2n and n2f, task to class n2c and c2n. Returns (nodes with role, edges)."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    task = n.select("graph_id", F.col("n").alias("id"), F.lit("task").alias("role"))
    cls = n.crossJoin(F.broadcast(classes)).select("graph_id", (F.col("n") + 1 + F.col("class")).alias("id"), F.lit("class").alias("role"))
    all_nodes = nodes.select("graph_id", "id", F.lit("feature").alias("role")).unionByName(task).unionByName(cls)
    up = nodes.join(n, "graph_id").select("graph_id", F.col("id").alias("src"), F.col("n").alias("dst"))
    down = cls.join(n, "graph_id").select("graph_id", F.col("n").alias("src"), F.col("id").alias("dst"))
    turned = lambda e: e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = None
    for e, name in ((up, "f2n"), (turned(up), "n2f"), (down, "n2c"), (turned(down), "c2n")):
        one = e.withColumn("type", F.lit(name))
        edges = one if edges is None else edges.unionByName(one)
    return all_nodes, edges


def supernode(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G14. A pooling node after each graph's n nodes, linked from all of them."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    extra = n.select("graph_id", F.col("n").alias("id"))
    links = nodes.join(n, "graph_id").select("graph_id", F.col("id").alias("src"), F.col("n").alias("dst"))
    return nodes.select("graph_id", "id").unionByName(extra), edges.select("graph_id", "src", "dst").unionByName(links)


def endpoint_flags(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """G16. Two further features of each sample's nodes: whether the node is the link's head or its tail."""
    both = nodes.join(links, "sample_id")
    flag = lambda c: (F.col("id") == F.col(c)).cast("double")
    return both.select("sample_id", "id", F.concat("x", F.array(flag("src"), flag("dst"))).alias("x"))


def rewire_edges(nodes: DataFrame, edges: DataFrame, share: float, seed=0) -> DataFrame:
    """G03. A seeded share of each graph's edges goes and as many random pairs of its nodes come."""
    kept = drop_edges(edges, share, seed)
    lost = edges.groupBy("graph_id").agg(F.floor(F.count(F.lit(1)) * share).cast("int").alias("k")).where("k > 0")
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    draws = lost.join(n, "graph_id").select("graph_id", "n", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("draw"))
    at = lambda c: F.pmod(F.conv(F.substring(md5_key(f"{seed}-{c}", "graph_id", "draw"), 1, 8), 16, 10).cast("long"), F.col("n")) + 1
    idx = wide_group_rank(nodes, ["graph_id"], [F.col("id")], "pos")
    pick = lambda c, name: idx.select("graph_id", F.col("pos").alias(c), F.col("id").alias(name))
    new = draws.select("graph_id", at("a").alias("a"), at("b").alias("b")).join(pick("a", "src"), ["graph_id", "a"]).join(pick("b", "dst"), ["graph_id", "b"])
    return kept.select("graph_id", "src", "dst").unionByName(new.select("graph_id", "src", "dst"))


def noise_features(nodes: DataFrame, share: float, replace: float, seed=0) -> DataFrame:
    """G05. Of each graph's nodes a seeded share is masked; of these, the first share ``replace`` takes another node's
    vector and the rest the zero vector."""
    rank = rank_for(["graph_id"], nodes)
    masked = _dropped(nodes, share, seed, rank).withColumnRenamed("drop", "mask")
    ranked = _ranked(masked, ["graph_id", "mask"], [md5_key(f"{seed}-noise", "graph_id", "id"), F.col("id")], rank)
    noisy = F.col("mask") & (F.col("rn") <= F.floor(F.col("_n") * replace))
    other = shuffle_features(nodes, f"{seed}-pool", rank).select("graph_id", "id", F.col("x").alias("_y"))
    zero = F.transform("x", lambda v: F.lit(0.0))
    return ranked.withColumn("noisy", noisy).join(other, ["graph_id", "id"]).withColumn("x", F.when(F.col("noisy"), F.col("_y")).when(F.col("mask"), zero).otherwise(F.col("x"))).drop("rn", "_n", "_y")


def grown_subset(nodes: DataFrame, edges: DataFrame, share: float, rounds: int, seed=0) -> DataFrame:
    """G08. (graph_id, id): a connected subset from a seeded start; each round the whole frontier joins in seeded order
    until the share of the graph's nodes is reached."""
    rank = rank_for(["graph_id"], nodes, edges)
    size = nodes.groupBy("graph_id").agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(1).cast("long")).alias("size"))
    cur = nodes.groupBy("graph_id").agg(F.min_by("id", F.struct(md5_key(seed, "graph_id", "id"), "id")).alias("id")).withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        near = cur.withColumnRenamed("id", "src").join(edges, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("id")).distinct()
        new = near.join(cur, ["graph_id", "id"], "left_anti").withColumn("round", F.lit(r))
        both = cur.unionByName(new).join(size, "graph_id")
        cur = rank(both, ["graph_id"], [F.col("round"), md5_key(f"{seed}-{r}", "graph_id", "id"), F.col("id")]).where(F.col("rn") <= F.col("size")).select("graph_id", "id", "round")
    return cur.select("graph_id", "id")


def mask_typed_nodes(nodes: DataFrame, share: float, seed=0, mask: int = -1) -> DataFrame:
    """G09. int(n * share + 1) seeded nodes of each graph get the mask type; the true type stays as ``original``."""
    ranked = _ranked(nodes, ["graph_id"], [md5_key(seed, "graph_id", "id"), F.col("id")])
    hit = F.col("rn") <= F.floor(F.col("_n") * share + 1)
    return ranked.select("graph_id", "id", F.col("type").alias("original"), F.when(hit, F.lit(mask)).otherwise(F.col("type")).alias("type"))


def blank_neighbours(pairs: DataFrame, first: int, percent: int, seed=0, tries: int = 5) -> DataFrame:
    """G10. (id, node, kept): the first neighbours of each node, each blanked with a probability; where all are
    blanked, the next try decides, and the last one keeps the first neighbour."""
    some = group_rank(pairs, ["id"], [F.col("node")]).where(F.col("rn") <= first)
    drawn = some.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t")).withColumn("on", md5_bucket(seed, "id", "node", "t", buckets=100) >= percent)
    good = drawn.groupBy("id", "t").agg(F.max(F.col("on").cast("int")).alias("any")).where("any = 1").groupBy("id").agg(F.min("t").alias("t"))
    return some.join(good.withColumnRenamed("t", "pick"), "id", "left").join(drawn.select("id", "node", F.col("t").alias("pick"), "on"), ["id", "node", "pick"], "left").select("id", "node", F.coalesce("on", F.col("rn") == 1).alias("kept"))


def episode_metagraph(episodes: DataFrame) -> DataFrame:
    """G13. (episode, src, dst, type): the rows of an episode, numbered in order of way, role and id, linked to class
    nodes that follow them: support rows by type 2, query rows by type 4."""
    n = F.count(F.lit(1)).over(Window.partitionBy("episode"))
    pos = group_rank(episodes.withColumn("_n", n), ["episode"], [F.col("way"), F.col("role"), F.col("id")])
    return pos.select("episode", (F.col("rn") - 1).cast("long").alias("src"), (F.col("_n") + F.col("way")).alias("dst"), F.when(F.col("role") == "support", 2).otherwise(4).alias("type"))


def typed_link_subgraph(inside: DataFrame, relations: int) -> DataFrame:
    """G15. (sample_id, src, dst, type): typed edges of a sample and their reverses, shifted by the relations."""
    return inside.select("sample_id", "src", "dst", "type").unionByName(inside.select("sample_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("type") + relations).alias("type")))
