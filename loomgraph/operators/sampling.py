"""Negative, neighbourhood and episode sampling in md5 order of (seed, keys)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import unused
from loomgraph.functions.ranking import first_rows, global_rank, group_rank, md5_bucket, md5_key, md5_rank, rank_for, wide_group_rank, wide_md5_rank
from loomgraph.functions.storage import discard, stash
from loomgraph.operators.edges import canonical, induced
from loomgraph.operators.paths import khop


def _with_ids(rows: DataFrame, first: int, last: int, name: str, step: int = 100_000) -> DataFrame:
    """Each row with every id from ``first`` to ``last``, in stretches of ``step``."""
    at, = unused([*rows.columns, name], "at")
    far = rows.withColumn(at, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(step).cast("long"))))
    return far.withColumn(name, F.explode(F.sequence(F.col(at), F.least(F.col(at) + step - 1, F.lit(last).cast("long"))))).drop(at)


def _first_drawn(draw: Callable[[int], DataFrame], gone: DataFrame, k: int, start: int, most: int, rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(src, dst): the first ``k`` distinct drawn pairs that are not in ``gone``, in the order of the draws. ``draw(n)`` is the first n
    of one sequence (id, src, dst), so a larger k only goes on. Draws are doubled up to ``most``, about twice as many as there
    are pairs; what they have not met by then, ``rest(met)``, follows in the md5 order of its column ``h``."""
    draws = min(start, most)
    while True:
        fresh = stash(draw(draws).join(gone, ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("id").alias("id")), "drawn")
        found = fresh.count()
        if found >= k or draws >= most:
            break
        discard(fresh)
        draws = min(2 * draws, most)
    first = first_rows(fresh, [F.col("id")], k).select("src", "dst")
    if found >= k:
        return first
    return first.unionByName(first_rows(rest(fresh.select("src", "dst")), [F.col("h"), F.col("src"), F.col("dst")], k - found).select("src", "dst"))


def negative_edges(edges: DataFrame, n_nodes: int, k: int, seed=0, over: float = 2.0, undirected: bool = False) -> DataFrame:
    """N01, N06. (src, dst): ``k`` distinct non-edges without self loops, or all where there are fewer, in the order of
    seeded draws of dense ids; undirected ones are src < dst. ``over`` * k draws are made at first, more where they do not do."""
    def draw(n: int) -> DataFrame:
        d = edges.sparkSession.range(n).select("id", md5_bucket(f"{seed}-a", "id", buckets=n_nodes).alias("src"), md5_bucket(f"{seed}-b", "id", buckets=n_nodes).alias("dst")).where("src <> dst")
        return d.select("id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")) if undirected else d

    def rest(met: DataFrame) -> DataFrame:
        ids = edges.sparkSession.range(n_nodes)
        pairs = _with_ids(ids.select(F.col("id").alias("src")), 0, n_nodes - 1, "dst").where("src < dst" if undirected else "src <> dst")
        return pairs.join(gone, ["src", "dst"], "left_anti").join(met, ["src", "dst"], "left_anti").withColumn("h", md5_key(f"{seed}-c", "src", "dst"))

    gone = edges.select("src", "dst").distinct()
    return _first_drawn(draw, gone, k, int(k * over) + 1, 2 * n_nodes * n_nodes, rest)


def batched_negatives(edges: DataFrame, nodes: DataFrame, per_graph: int, seed=0, over: int = 3) -> DataFrame:
    """N02. (graph_id, src, dst): ``per_graph`` non-edges in each graph among its nodes (graph_id, id), or all where there are fewer.
    The first are found by ``over`` x ``per_graph`` draws; graphs that these leave short go on through their other pairs in md5
    order, which are few in small graphs and about as many as the edges in dense ones."""
    idx = rank_for(["graph_id"], nodes)(nodes, ["graph_id"], [F.col("id")], "pos")
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    draws = n.select("graph_id", "n", F.explode(F.sequence(F.lit(0), F.lit(per_graph * over - 1))).alias("draw"))
    at = lambda c: (F.pmod(F.conv(F.substring(md5_key(f"{seed}-{c}", "graph_id", "draw"), 1, 8), 16, 10).cast("long"), F.col("n")) + 1).alias(c)
    named = draws.select("graph_id", "draw", at("a"), at("b"))
    pick = lambda c, name: idx.select("graph_id", F.col("pos").alias(c), F.col("id").alias(name))
    pairs = named.join(pick("a", "src"), ["graph_id", "a"]).join(pick("b", "dst"), ["graph_id", "b"]).where("src <> dst")
    gone = edges.select("graph_id", "src", "dst")
    fresh = stash(pairs.join(gone, ["graph_id", "src", "dst"], "left_anti").groupBy("graph_id", "src", "dst").agg(F.min("draw").alias("draw")), "drawn")
    found = fresh.groupBy("graph_id").agg(F.count(F.lit(1)).alias("found"))
    short = n.join(found, "graph_id", "left").where(F.coalesce("found", F.lit(0)) < per_graph).select("graph_id")
    left = nodes.join(short, "graph_id", "left_semi").select("graph_id", F.col("id").alias("src"))
    rest = left.join(left.withColumnRenamed("src", "dst"), "graph_id").where("src <> dst").join(gone, ["graph_id", "src", "dst"], "left_anti")
    rest = rest.join(fresh.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")
    # drawn ones first, then by hash
    every = fresh.select("graph_id", "src", "dst", F.lpad(F.col("draw").cast("string"), 19, "0").alias("h")).unionByName(
        rest.withColumn("h", F.concat(F.lit("r"), md5_key(f"{seed}-c", "graph_id", "src", "dst"))))
    return group_rank(every, ["graph_id"], [F.col("h"), F.col("src"), F.col("dst")]).where(F.col("rn") <= per_graph).select("graph_id", "src", "dst")


def structured_negatives(edges: DataFrame, n_nodes: int, tries: int, seed=0) -> DataFrame:
    """N03. (src, dst, neg): for each edge a drawn node that src is not linked to, the first of ``tries``; where all miss, one of
    the nodes that are free for src, by hash. Null only where src is linked to all others."""
    links = edges.select("src", "dst")
    draws = links.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t"))
    drawn = draws.withColumn("neg", md5_bucket(seed, "src", "dst", "t", buckets=n_nodes)).where("neg <> src")
    known = edges.select("src", F.col("dst").alias("neg")).distinct()
    first = drawn.join(known, ["src", "neg"], "left_anti").groupBy("src", "dst").agg(F.min_by("neg", "t").alias("neg"))
    told = stash(links.join(first, ["src", "dst"], "left"), "negatives")
    missed = told.where("neg is null").select("src", "dst")
    free = _with_ids(missed.select("src").distinct(), 0, n_nodes - 1, "neg").where("neg <> src").join(known, ["src", "neg"], "left_anti")
    ranked = wide_group_rank(free.withColumn("h", md5_key(f"{seed}-r", "src", "neg")), ["src"], [F.col("h"), F.col("neg")], "pos").drop("h")
    count = ranked.groupBy("src").agg(F.max("pos").alias("c"))
    at = F.pmod(F.conv(F.substring(md5_key(f"{seed}-p", "src", "dst"), 1, 8), 16, 10).cast("long"), F.col("c")) + 1
    second = missed.join(count, "src", "left").withColumn("pos", at).join(ranked, ["src", "pos"], "left").select("src", "dst", "neg")
    return told.where("neg is not null").unionByName(second)


def structured_feasible(edges: DataFrame, n_nodes: int, loops: bool = False) -> DataFrame:
    """N03. (feasible): whether every node has some node that it is not linked to."""
    e = edges.select("src", "dst").distinct() if loops else edges.where("src <> dst").select("src", "dst").distinct()
    most = e.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("d"))
    return most.select((F.col("d") < (n_nodes if loops else n_nodes - 1)).alias("feasible"))


def same_source_negatives(positives: DataFrame, n_nodes: int, m: int, seed=0) -> DataFrame:
    """N04. (src, dst, i, neg): m random targets for each positive; collisions are allowed."""
    d = positives.select("src", "dst", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("i"))
    return d.withColumn("neg", md5_bucket(seed, "src", "dst", "i", buckets=n_nodes))


def complement_negatives(edges: DataFrame | None, nodes: DataFrame, k: int, seed=0, group: str | None = None) -> DataFrame:
    """N05. (src < dst): ``k`` of all non-edges, or all where there are fewer, in the order of seeded draws of two nodes; one order
    for every k, so a larger k takes a superset. Draws are doubled until enough differ from the edges and each other; what twice
    as many draws as there are ordered pairs have not met follows in md5 order, which is needed only where k is most of the
    non-edges or these are few beside the edges. With ``group``, a column of the nodes, the edges are all pairs of nodes of one
    group; they are then counted and told apart by the group and never made."""
    if group is not None:
        return _between_groups(nodes.select("id", F.col(group).alias("g")), k, seed)
    ids = stash(global_rank(nodes.select("id").distinct(), [F.col("id")], "at"), "ids")
    gone = stash(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), "linked")
    n, m = ids.count(), gone.count()
    free = max(n * (n - 1) // 2 - m, 1)

    def draw(draws: int) -> DataFrame:
        drawn = edges.sparkSession.range(draws).select("id", (md5_bucket(f"{seed}-a", "id", buckets=n) + 1).alias("a"), (md5_bucket(f"{seed}-b", "id", buckets=n) + 1).alias("b")).where("a <> b")
        return drawn.join(ids.toDF("x", "a"), "a").join(ids.toDF("y", "b"), "b").select("id", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))

    def rest(met: DataFrame) -> DataFrame:
        pairs = _with_ids(ids.select(F.col("id").alias("src"), "at"), 1, n, "to").where(F.col("to") > F.col("at"))
        named = pairs.join(ids.select(F.col("id").alias("dst"), F.col("at").alias("to")), "to").select("src", "dst")
        return named.join(gone, ["src", "dst"], "left_anti").join(met, ["src", "dst"], "left_anti").withColumn("h", md5_key(f"{seed}-c", "src", "dst"))

    if n < 2:
        return gone.limit(0)
    return _first_drawn(draw, gone, k, int(1.5 * min(k, free) * n * n / (2 * free)) + 100, 2 * n * n, rest)


def _between_groups(nodes: DataFrame, k: int, seed) -> DataFrame:
    """:func:`complement_negatives` of nodes (id, g), each once, where those of one group are linked; a null group links nothing."""
    ids = stash(global_rank(nodes, [F.col("id")], "at"), "ids")
    n = ids.count()
    known = ids.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    free = max(n * (n - 1) // 2 - int(known.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0), 1)
    apart = (F.col("a_g") != F.col("b_g")) | F.col("a_g").isNull() | F.col("b_g").isNull()
    side = lambda c, x: ids.select(F.col("id").alias(x), F.col("g").alias(f"{c}_g"), F.col("at").alias(c))

    def draw(draws: int) -> DataFrame:
        drawn = nodes.sparkSession.range(draws).select("id", (md5_bucket(f"{seed}-a", "id", buckets=n) + 1).alias("a"), (md5_bucket(f"{seed}-b", "id", buckets=n) + 1).alias("b")).where("a <> b")
        return drawn.join(side("a", "x"), "a").join(side("b", "y"), "b").where(apart).select("id", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))

    def rest(met: DataFrame) -> DataFrame:
        pairs = _with_ids(side("a", "src"), 1, n, "b").where(F.col("b") > F.col("a")).join(side("b", "dst"), "b").where(apart).select("src", "dst")
        return pairs.join(met, ["src", "dst"], "left_anti").withColumn("h", md5_key(f"{seed}-c", "src", "dst"))

    none = ids.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    return none if n < 2 else _first_drawn(draw, none, k, int(1.5 * min(k, free) * n * n / (2 * free)) + 100, 2 * n * n, rest)


def hard_negatives(edges: DataFrame, k: int, seed=0) -> DataFrame:
    """N07. (src < dst): a seeded choice of ``k`` unlinked pairs that share a neighbour."""
    wedge = edges.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").where("src < dst").select("src", "dst").distinct()
    free = wedge.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return first_rows(free, [md5_key(seed, "src", "dst"), F.col("src"), F.col("dst")], k)


def far_negative(roots: DataFrame, edges: DataFrame, n_nodes: int, hops: int, tries: int, seed=0) -> DataFrame:
    """N08. (root, neg): the first of ``tries`` drawn nodes outside the root's ball; where all miss, the first of the nodes outside
    in md5 order. Null only where the ball holds all nodes."""
    ball = stash(khop(roots.select("root", F.col("root").alias("node")), edges, hops, ["root"]).select("root", "node"), "balls")
    draws = roots.select("root", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t")).withColumn("node", md5_bucket(seed, "root", "t", buckets=n_nodes))
    first = draws.join(ball, ["root", "node"], "left_anti").groupBy("root").agg(F.min_by("node", "t").alias("neg"))
    told = stash(roots.select("root").join(first, "root", "left"), "negatives")
    missed = told.where("neg is null").select("root")
    # a ball that all draws hit holds most nodes
    free = _with_ids(missed, 0, n_nodes - 1, "node").join(ball, ["root", "node"], "left_anti")
    second = free.groupBy("root").agg(F.min_by("node", F.struct(md5_key(f"{seed}-r", "root", "node"), "node")).alias("neg"))
    return told.where("neg is not null").unionByName(missed.join(second, "root", "left"))


def supervision_edges(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """N09. (src, dst, y) of positives and of the negatives array ``negs`` of each source."""
    return positives.select("src", "dst", F.lit(1).alias("y")).unionByName(negatives.select("src", F.explode("negs").alias("dst"), F.lit(0).alias("y")))


def capped_khop(roots: DataFrame, edges: DataFrame, hops: int, cap: int, seed=0) -> DataFrame:
    """N10. (root, node, hop): rings around each root, each cut to ``cap`` nodes in seeded order; the full ring counts as
    visited, and only kept nodes are expanded."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
    kept = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"))
    front, seen, out = kept, kept.select("root", "node"), kept
    for h in range(1, hops + 1):
        ring = front.join(step, "node").select("root", F.col("_to").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        ring = stash(ring, "ring") if h < hops else ring
        seen = seen.unionByName(ring)
        front = group_rank(ring, ["root"], [md5_key(f"{seed}-{h}", "root", "node"), F.col("node")]).where(F.col("rn") <= cap).select("root", "node", F.lit(h).alias("hop"))
        front = stash(front, "front") if h < hops else front
        out = out.unionByName(front)
    return out


def enclosing_subgraphs(links: DataFrame, edges: DataFrame, hops: int, ratio: float = 1.0, cap: int | None = None, directed: bool = False, seed=0) -> DataFrame:
    """N11. (sample_id, src, dst): edges among the nodes found within ``hops`` of either end of a link, without the link.
    Of each ring a seeded share ``ratio`` (rounded down) is kept, at most ``cap`` nodes; only kept nodes are expanded, and
    no node of a ring is met again. ``directed`` rings follow the edges both ways, while else the edges hold both ways."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
    if directed:
        step = step.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("_to"))).distinct()
    key = ["sample_id", "node"]
    seen = front = links.select("sample_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    kept = front
    for h in range(1, hops + 1):
        ring = front.join(step, "node").select("sample_id", F.col("_to").alias("node")).distinct().join(seen, key, "left_anti")
        front = ring
        if ratio < 1 or cap is not None:
            ring = stash(ring, "ring")  # the cut and what was seen must agree, whatever is computed again
            n = ring.groupBy("sample_id").agg(F.floor(F.count(F.lit(1)) * ratio).alias("_n"))
            ranked = wide_group_rank(ring.join(n, "sample_id"), ["sample_id"], [md5_key(f"{seed}-{h}", "sample_id", "node"), F.col("node")])
            front = ranked.where(F.col("rn") <= F.least("_n", F.lit(cap if cap is not None else 1 << 62))).select(*key)
        if h < hops:
            seen, front = stash(seen.unionByName(ring), "seen"), stash(front, "front")
        kept = kept.unionByName(front)
    ball = kept.select("sample_id", F.col("node").alias("id"))
    inside = ball.withColumnRenamed("id", "src").join(edges.select("src", "dst"), "src").join(ball.withColumnRenamed("id", "dst"), ["sample_id", "dst"], "left_semi")
    gone = links.select("sample_id", *canonical())
    return inside.withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")}).join(gone, ["sample_id", "_lo", "_hi"], "left_anti").select("sample_id", "src", "dst")


def tree_positions(roots: DataFrame, edges: DataFrame, fanouts: list[int], pad: int = -1, seed=0) -> DataFrame:
    """N12. (root, pos, node): the root and, level by level, ``s`` seeded neighbours of each position, padded; every root
    gets the same number of positions."""
    ranked = wide_md5_rank(edges.withColumn("_k", F.concat_ws("-", "src", "dst")), seed, "_k", ["src"]).select(F.col("src").alias("node"), "rn", F.col("dst").alias("_to"))
    level = roots.select("root", F.lit(0).alias("pos"), F.col("root").alias("node"))
    out, base, width = level, 1, 1
    for s in fanouts:
        slots = level.select("root", "pos", "node", F.explode(F.sequence(F.lit(1), F.lit(s))).alias("rn"))
        start = base - width
        level = slots.join(ranked, ["node", "rn"], "left").select("root", (F.lit(base) + (F.col("pos") - start) * s + F.col("rn") - 1).cast("int").alias("pos"), F.coalesce("_to", F.lit(pad).cast("long")).alias("node"))
        out = out.unionByName(level)
        width *= s
        base += width
    return out


def fixed_tree(roots: DataFrame, edges: DataFrame, fanouts: list[int], pad: int = -1, seed=0) -> DataFrame:
    """N12. (root, nodes): the nodes of :func:`tree_positions` in their order."""
    return tree_positions(roots, edges, fanouts, pad, seed).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes"))


def fanout_sample(roots: DataFrame, edges: DataFrame, sizes: list[int], limit: int, seed=0) -> DataFrame:
    """N13. (root, node, hop): per hop at most ``size`` seeded neighbours of each frontier node, at most ``limit`` nodes
    of each root in order of hop and id."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
    out = front = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"))
    for h, size in enumerate(sizes, 1):
        near = front.join(step, "node")
        kept = group_rank(near, ["root", "node"], [md5_key(f"{seed}-{h}", "root", "node", "_to"), F.col("_to")]).where(F.col("rn") <= size)
        front = kept.select("root", F.col("_to").alias("node")).distinct().join(out.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(h).alias("hop"))
        front = stash(front, "front") if h < len(sizes) else front
        out = out.unionByName(front)
    return group_rank(out, ["root"], [F.col("hop"), F.col("node")]).where(F.col("rn") <= limit).drop("rn")


def one_edge_per_node(edges: DataFrame, seed=0) -> DataFrame:
    """N14. (node, edge): one incident edge of each node, -1 - id where the node is its target."""
    both = edges.select(F.col("src").alias("node"), F.col("edge_id").alias("edge")).unionByName(edges.select(F.col("dst").alias("node"), (-1 - F.col("edge_id")).alias("edge")))
    return both.groupBy("node").agg(F.min_by("edge", F.struct(md5_key(seed, "node", "edge"), "edge")).alias("edge"))


def random_walk(roots: DataFrame, edges: DataFrame, steps: int, seed=0) -> DataFrame:
    """N15. (root, step, node): uniform steps; a walk ends where there is no edge."""
    adj = wide_group_rank(edges.select("src", "dst").distinct(), ["src"], [F.col("dst")]).select(F.col("src").alias("node"), (F.col("rn") - 1).alias("_i"), F.col("dst").alias("_to"))
    deg = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_d"))
    out = at = roots.select("root", F.lit(0).alias("step"), F.col("root").alias("node"))
    for t in range(1, steps + 1):
        h = F.conv(F.substring(md5_key(f"{seed}-{t}", "root"), 1, 8), 16, 10).cast("long")
        at = at.join(deg, "node").withColumn("_i", F.pmod(h, F.col("_d"))).join(adj, ["node", "_i"]).select("root", F.lit(t).alias("step"), F.col("_to").alias("node"))
        out = out.unionByName(at)
    return out


def ego_sample(roots: DataFrame, edges: DataFrame, size: int, seed=0) -> DataFrame:
    """N16. (root, src, dst): induced edges of each root's sampled 1-hop ego."""
    ego = capped_khop(roots, edges, 1, size, seed).select("root", F.col("node").alias("id"))
    e = ego.withColumnRenamed("id", "src").join(edges.select("src", "dst"), "src")
    return induced(e, ego, ["root"]).select("root", "src", "dst")


def neighbour_lists(edges: DataFrame, only_second: bool = False) -> DataFrame:
    """N17. (id, nodes): nodes at one or two steps, or those at two steps that are no neighbours, without the node."""
    one = edges.select(F.col("src").alias("id"), F.col("dst").alias("node")).distinct()
    two = one.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")), "node").select("id", F.col("_to").alias("node")).where("id <> node").distinct()
    both = two.join(one, ["id", "node"], "left_anti") if only_second else one.unionByName(two).where("id <> node").distinct()
    return both.groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def substructure_context(roots: DataFrame, edges: DataFrame, k: int, l1: int, l2: int) -> DataFrame:
    """N19. (root, node, part): core within k, context between l1 and l2, overlap in both."""
    ball = khop(roots.select("root", F.col("root").alias("node")), edges, max(k, l2), ["root"])
    core, ring = F.col("hop") <= k, (F.col("hop") >= l1) & (F.col("hop") <= l2)
    return ball.select("root", "node", F.explode(F.array_compact(F.array(F.when(core, "core"), F.when(ring, "context"), F.when(core & ring, "overlap")))).alias("part"))


def few_shot_episodes(rows: DataFrame, episodes: int, ways: int, shots: int, queries: int, seed=0) -> DataFrame:
    """N20, N25. (episode, way, label, id, role): ``ways`` seeded classes of each episode with ``shots`` support and
    ``queries`` query rows; classes with fewer rows are never drawn."""
    enough = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shots + queries).select("label")
    eps = rows.sparkSession.range(episodes).select(F.col("id").alias("episode"))
    classes = eps.crossJoin(F.broadcast(enough))  # episodes x classes: both are parameters of the task
    drawn = group_rank(classes, ["episode"], [md5_key(f"{seed}-way", "episode", "label"), F.col("label")], "way").where(F.col("way") <= ways)
    pool = drawn.join(rows.select("label", "id"), "label")
    ranked = group_rank(pool, ["episode", "label"], [md5_key(f"{seed}-row", "episode", "id"), F.col("id")]).where(F.col("rn") <= shots + queries)
    return ranked.select("episode", (F.col("way") - 1).alias("way"), "label", "id", F.when(F.col("rn") <= shots, "support").otherwise("query").alias("role"))


def task_ways(rows: DataFrame, tasks: int, key: str = "way") -> DataFrame:
    """N24. Ways dealt to tasks in turn: task and position in it."""
    return rows.withColumns({"task": F.col(key) % tasks, "local": F.floor(F.col(key) / tasks)})


def ragged_select(rows: DataFrame, percent: int, seed=0, keys=("g", "pos")) -> DataFrame:
    """N26. Elements kept with a probability, by their own hash."""
    return rows.where(md5_bucket(seed, *keys, buckets=100) < percent)


def dataset_mixture(tables: dict[str, DataFrame], multiples: dict[str, float], seed=0, key: str = "id") -> DataFrame:
    """N27. Union of the tables, each repeated by its multiple; the fraction of a multiple is a seeded choice."""
    out = None
    for name, df in tables.items():
        m = multiples[name]
        extra = (md5_bucket(f"{seed}-{name}", key, buckets=1000) < int(round((m - int(m)) * 1000))).cast("int")
        one = df.withColumn("_t", F.lit(int(m)) + extra).where("_t > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_t"))).alias("copy"), F.lit(name).alias("dataset")).drop("_t")
        out = one if out is None else out.unionByName(one)
    return out


def mixture_multiples(metrics: DataFrame, members: DataFrame, settings: DataFrame, window: int = 3) -> DataFrame:
    """N27. (dataset, round, waited, multiple): the multiple of each dataset after each evaluation round, for :func:`dataset_mixture`.

    ``metrics`` (round, task, value), ``members`` (dataset, task, mode: 1 for larger is better, -1 for smaller), ``settings`` (dataset,
    multiple, floor, patience). A round is a gain where the dataset's values, relative to their mean over the ``window`` rounds before,
    sum to more than 0; ``waited`` counts the rounds since the last gain, and each round that waits more than ``patience`` halves
    the multiple, down to the floor. The first ``window`` rounds are not judged; a mean of 0 or null is no gain. A dataset's windows
    hold a row for each round."""
    per = metrics.join(members, "task").groupBy("dataset", "round").agg(
        F.sum("value").alias("s"), F.count("value").alias("n"), F.sum(F.col("mode") * F.col("value")).alias("sv"), F.sum("mode").alias("sm"))
    rounds = Window.partitionBy("dataset").orderBy("round")
    before, upto = rounds.rowsBetween(-window, -1), rounds.rowsBetween(Window.unboundedPreceding, 0)
    seen = per.select("dataset", "round", "sv", "sm", (F.sum("s").over(before) / F.sum("n").over(before)).alias("mean"), F.row_number().over(rounds).alias("pos"))
    gain = (F.col("pos") > window) & (F.try_divide(F.col("sv") - F.col("mean") * F.col("sm"), F.col("mean")) > 0)
    last = F.coalesce(F.max(F.when(gain, F.col("pos"))).over(upto), F.lit(window))
    waiting = seen.withColumn("waited", F.greatest(F.col("pos") - last, F.lit(0))).join(settings, "dataset")
    halved = F.sum((F.col("waited") > F.col("patience")).cast("int")).over(upto)
    multiple = F.when(halved > 0, F.greatest("floor", F.col("multiple") * F.pow(F.lit(0.5), halved))).otherwise(F.col("multiple"))
    return waiting.select("dataset", "round", "waited", multiple.alias("multiple"))


def anchored_episodes(queries: DataFrame, rows: DataFrame, ways: int, shots: int, seed=0) -> DataFrame:
    """N21. (query_id, way, label, id): the query's own class first, then ``ways`` - 1 seeded others, each with
    ``shots`` rows other than the query. Classes are few: each query meets all of them once."""
    enough = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > shots) & F.col("label").isNotNull()).select("label")
    q = queries.select(F.col("id").alias("query_id"), F.col("label").alias("own")).join(enough.withColumnRenamed("label", "own"), "own", "left_semi")
    shown = md5_rank(rows, f"{seed}-row", "id", ["label"]).where(F.col("rn") <= shots + 1).join(enough, "label", "left_semi")
    known = shown.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda r: r["id"]).alias("ids"))
    # one row, of every class with its first rows
    table = known.agg(F.collect_list(F.struct("label", "ids")).alias("classes"))
    h = lambda c: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), c["label"].cast("string")))
    keyed = F.transform("classes", lambda c: F.struct((c["label"] != F.col("own")).alias("other"), h(c).alias("h"), c["label"].alias("label"), c["ids"].alias("ids")))
    drawn = q.crossJoin(F.broadcast(table)).select("query_id", F.posexplode(F.slice(F.array_sort(keyed), 1, ways)).alias("way", "c"))
    own = F.slice(F.filter("c.ids", lambda i: i != F.col("query_id")), 1, shots)
    return drawn.select("query_id", "way", F.col("c.label").alias("label"), F.explode(own).alias("id"))


def multiclass_shots(rows: DataFrame, shots: int, seed=0) -> DataFrame:
    """N22. (label, shot, id): ``shots`` train rows of each class, again from the first where a class is too small."""
    ranked = md5_rank(rows, seed, "id", ["label"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    some = ranked.where(F.col("rn") <= shots)
    times = some.select("label", "id", F.explode(F.sequence(F.col("rn").cast("long"), F.lit(shots).cast("long"), F.greatest(F.col("n"), F.lit(1).cast("long")))).alias("shot"))
    return times.select("label", (F.col("shot") - 1).alias("shot"), "id")


def neighbour_tasks(walks: DataFrame, members: int) -> DataFrame:
    """N23. (label, member): seeds as labels with the nodes that their walks reach, for seeds with at least
    ``members`` of them; the first ``members`` by id, the seed itself included."""
    reached = walks.select(F.col("root").alias("label"), F.col("node").alias("member")).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return group_rank(reached.withColumn("_n", n), ["label"], [F.col("member")]).where((F.col("_n") >= members) & (F.col("rn") <= members)).select("label", "member")
