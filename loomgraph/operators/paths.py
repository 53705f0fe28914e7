"""Distances, personalised PageRank and node labels, all keyed searches: one job serves many roots or links.

Searches keep (key, node) frontiers; a round is one join with the edges and one anti join with what was seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ranking import global_rank
from loomgraph.functions.skew import join_by_count
from loomgraph.functions.storage import discard, stash


def khop(roots: DataFrame, edges: DataFrame, hops: int, keys: list[str], blocked: DataFrame | None = None) -> DataFrame:
    """H01. (keys, node, hop): nodes within ``hops`` of each root (keys, node), the root at 0. ``blocked`` (keys, node)
    may not be entered."""
    seen = roots.select(*keys, "node", F.lit(0).alias("hop")).distinct()
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
    cols = [*keys, "node"]
    for h in range(1, hops + 1):
        front = seen.where(F.col("hop") == h - 1).join(step, "node").select(*keys, F.col("_to").alias("node")).distinct()
        if blocked is not None:
            front = front.join(blocked, cols, "left_anti")
        new = front.join(seen.select(*cols), cols, "left_anti").select(*cols, F.lit(h).alias("hop"))
        seen = stash(seen.unionByName(new), "khop") if h < hops else seen.unionByName(new)
    return seen


def exact_hop(found: DataFrame, hop: int) -> DataFrame:
    """H01. Nodes at exactly this distance."""
    return found.where(F.col("hop") == hop).drop("hop")


def shortest_distances(pairs: DataFrame, edges: DataFrame, hops: int, beyond: int = -1) -> DataFrame:
    """H02. (src, dst, spd): distance of each pair up to ``hops``; 0 to itself, ``beyond`` if it is farther."""
    found = khop(pairs.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct(), edges, hops, ["root"])
    return pairs.join(found.select(F.col("root").alias("src"), F.col("node").alias("dst"), "hop"), ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("hop", F.lit(beyond)).alias("spd")
    )


def neighbours_by_distance(found: DataFrame, keys: list[str]) -> DataFrame:
    """H02. (keys, hop, nodes sorted)."""
    return found.groupBy(*keys, "hop").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def _transition(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, _to, _p): outgoing shares of each node; a hub's edges are not gathered in one task."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"), w.cast("double").alias("_w"))
    sums = stash(e.groupBy("node").agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("n")), "strength")
    size = sums.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    joined = join_by_count(e, sums, ["node"], size["n"] or 0, largest=size["most"] or 0)
    return joined.select("node", "_to", (F.col("_w") / F.col("_t")).alias("_p"))


#: Sources of a block: a row of :func:`ppr_power` has two numbers for each.
SOURCES = 128


def _is_symmetric(edges: DataFrame) -> bool:
    """Whether every edge has its opposite as often."""
    once = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    back = once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    return once.join(back, ["src", "dst", "n"], "left_anti").limit(1).count() == 0


def _added(pieces: Iterator[tuple[list, list, np.ndarray]]) -> pa.RecordBatch:
    """Vectors of the same (blk, node) added up; what a task holds is a vector for each of its keys."""
    place, sums, used = {}, np.zeros((64, 1)), 0
    for blk, node, v in pieces:
        if sums.shape[1] != v.shape[1]:
            sums = np.zeros((64, v.shape[1]))
        at = np.fromiter((place.setdefault(k, len(place)) for k in zip(blk, node, strict=True)), np.int64, len(blk))
        if len(place) > len(sums):
            sums = np.vstack([sums, np.zeros((max(len(place), 2 * len(sums)) - len(sums), v.shape[1]))])
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        if len(first):
            sums[at[order][first]] += np.add.reduceat(v[order], first, axis=0)
        used = len(place)
    keys = list(place)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([r.tobytes() for r in sums[:used]], pa.binary())], names=["blk", "node", "v"])


def ppr_power(links: DataFrame, edges: DataFrame, damping: float = 0.85, tol: float = 1e-7, max_rounds: int | None = None, cut_every: int = 8) -> DataFrame:
    """H06. (src, dst, score): personalised PageRank of dst from src by iteration of x = (1 - damping) e + damping P' x. Mass of nodes
    without edges returns to the source. A source stops when a round changes it by ``tol`` in sum at most; without
    ``max_rounds`` as many rounds are made as that can take. It is an error if they do not do. A source without an edge
    has all its mass, a null source a score of 0.

    Sources are numbered and cut into blocks of ``SOURCES``. A row is a node and a block with a dense array, the last two
    values of each source there; a round is one join with the edges and one shuffle by node, in which the arrays are added. Every
    ``cut_every`` rounds the state is stored, the links of settled sources are answered, and those leave their block: rows
    without others go. Where each edge has its opposite, the walk's eigenvalues are real, and Chebyshev's weights of the last two
    values settle it in a third of the rounds; the weights of a plain power iteration are 1."""
    edges = stash(edges.select("src", "dst").where("src is not null and dst is not null"), "edges")
    quick = _is_symmetric(edges)
    if max_rounds is None:
        rate = damping / (1 + math.sqrt(1 - damping**2)) if quick else damping
        max_rounds = 2 * math.ceil(math.log(tol / 4) / math.log(rate)) + 2 * cut_every if rate else cut_every
    width = SOURCES
    of = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    sources = links.select(F.col("src").alias("root")).where("root is not null").distinct()
    linked = sources.join(edges.select(F.col("src").alias("root")).distinct(), "root", "left_semi")
    roots = global_rank(linked, [F.col("root")])
    roots = stash(roots.select("root", F.floor((F.col("rn") - 1) / width).alias("blk"), ((F.col("rn") - 1) % width).cast("int").alias("at")), "roots")
    asked = stash(links.join(roots.withColumnRenamed("root", "src"), "src"), "asked")
    alone = links.join(sources.join(roots, "root", "left_anti").withColumnRenamed("root", "src"), "src", "left_semi")
    # where a node's mass goes: along its edges, or, without any, to its block's own home, from there to the block's sources, each
    # its own; and one row that keeps what the node has
    share = _transition(edges).select(of("node").alias("node"), of("_to").alias("to"), (damping * F.col("_p")).alias("p"))
    nodes = edges.select(of("src").alias("node")).unionByName(edges.select(of("dst").alias("node"))).distinct()
    dead = nodes.join(share.select("node").distinct(), "node", "left_anti").select("node", F.lit(None).cast("string").alias("to"), F.lit(damping).alias("p"))
    home = roots.select(F.concat(F.lit("h"), "blk").alias("node"), of("root").alias("to"), F.lit(1.0).alias("p"), "at")
    moves = share.unionByName(dead).withColumn("at", F.lit(-1)).unionByName(home)
    every = nodes.unionByName(home.select("node").distinct())
    step = stash(moves.unionByName(every.select("node", F.col("node").alias("to"), F.lit(0.0).alias("p"), F.lit(-2).alias("at"))), "transition")
    start = roots.select("blk", of("root").alias("node"), F.lit(0.0).alias("p"), (-3 - F.col("at")).alias("at"), F.lit(None).cast("binary").alias("v"))

    def round_of(state: DataFrame, weight: float) -> DataFrame:
        """x_next = weight * (P' x + start) + (1 - weight) * x_before, beside x."""
        go = state.join(step, "node").select("blk", F.coalesce("to", F.concat(F.lit("h"), "blk")).alias("node"), "p", "at", F.when(F.col("at") == -2, F.col("v")).otherwise(F.substring("v", 1, 8 * width)).alias("v"))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[tuple[list, list, np.ndarray]]:
                for whole in batches:
                    for s in range(0, whole.num_rows, 4_096):
                        b = whole.slice(s, 4_096)
                        at, p = np.asarray(b.column("at")), np.asarray(b.column("p"))
                        rows, new = b.column("v").to_pylist(), np.zeros((b.num_rows, 2 * width))
                        go, keep, first = np.flatnonzero(at >= -1), np.flatnonzero(at == -2), np.flatnonzero(at <= -3)
                        new[go, :width] = np.frombuffer(b"".join(rows[i] for i in go)).reshape(-1, width) * (weight * p[go])[:, None]
                        own = np.flatnonzero(at >= 0)  # from home, to one source each
                        new[own, :width] = np.where(np.arange(width)[None] == at[own, None], new[own, :width], 0)
                        kept = np.frombuffer(b"".join(rows[i] for i in keep)).reshape(-1, 2 * width)
                        new[keep] = np.hstack([(1 - weight) * kept[:, width:], kept[:, :width]])
                        new[first, -3 - at[first]] = weight * (1 - damping)
                        yield b.column("blk").to_pylist(), b.column("node").to_pylist(), new

            yield _added(pieces())

        tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return go.unionByName(start).repartition(tasks, "blk", "node").mapInArrow(add, "blk long, node string, v binary")

    def changes(state: DataFrame) -> DataFrame:
        """(blk, at, c): what the last round has changed of each source."""
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for blk, v in zip(b.column("blk").to_pylist(), b.column("v").to_pylist(), strict=True):
                    v = np.frombuffer(v)
                    held[blk] = held.get(blk, 0) + np.abs(v[:width] - v[width:])
            for blk, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([blk] * width, pa.int64()), pa.array(range(width), pa.int32()), pa.array(c)], names=["blk", "at", "c"])

        return state.select("blk", "v").mapInArrow(measure, "blk long, at int, c double").groupBy("blk", "at").agg(F.sum("c").alias("c"))

    def picked(rows: DataFrame) -> DataFrame:
        """(src, dst, score) of (src, dst, at, v)."""
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                score = [np.frombuffer(v)[at] if v is not None else 0.0 for v, at in zip(b.column("v").to_pylist(), b.column("at").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(score, pa.float64())], names=["src", "dst", "score"])

        kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}
        return rows.select("src", "dst", "at", "v").mapInArrow(pick, f"src {kinds['src']}, dst {kinds['dst']}, score double")

    def without(state: DataFrame, stay: DataFrame) -> DataFrame:
        """The values of the sources ``stay`` (blk, stay) only."""
        def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for v, at in zip(b.column("v").to_pylist(), b.column("stay").to_pylist(), strict=True):
                    v, kept = np.frombuffer(v).reshape(2, width), np.zeros((2, width))
                    kept[:, at] = v[:, at]
                    out.append(kept.tobytes() if kept.any() else None)
                yield pa.RecordBatch.from_arrays([b.column("blk"), b.column("node"), pa.array(out, pa.binary())], names=["blk", "node", "v"])

        return state.join(stay, "blk").select("blk", "node", "stay", "v").mapInArrow(mask, "blk long, node string, v binary").where("v is not null")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros((b.num_rows, 2 * width))
            v[np.arange(b.num_rows), np.asarray(b.column("at"))] = 1
            yield pa.RecordBatch.from_arrays([b.column("blk"), b.column("node"), pa.array([r.tobytes() for r in v], pa.binary())], names=["blk", "node", "v"])

    state = roots.select("blk", of("root").alias("node"), "at").mapInArrow(unit, "blk long, node string, v binary")
    parts, old, left, weight = [], None, roots.count(), 1.0
    for r in range(1, max_rounds + 1):
        if not left:
            break
        if quick and r > 1:
            weight = 1 / (1 - damping**2 / 2) if r == 2 else 1 / (1 - damping**2 * weight / 4)
        state = round_of(state, weight)
        if r % cut_every and r < max_rounds:
            continue
        state = stash(state, "ppr")
        told = stash(roots.join(changes(state), ["blk", "at"], "left").withColumn("settled", F.coalesce(F.col("c") <= tol, F.lit(True))).drop("c"), "settled")
        done, left = told.agg(F.count_if("settled"), F.count_if(~F.col("settled"))).first()
        if done:
            now = told.where("settled").select(F.col("root").alias("src"))
            found = asked.join(now, "src", "left_semi").withColumn("node", of("dst")).join(state, ["blk", "node"], "left")
            parts.append(stash(picked(found), "scores"))
            roots = stash(told.where(~F.col("settled")).drop("settled"), "roots")
            start = roots.select("blk", of("root").alias("node"), F.lit(0.0).alias("p"), (-3 - F.col("at")).alias("at"), F.lit(None).cast("binary").alias("v"))
            masked = stash(without(state, roots.groupBy("blk").agg(F.collect_set("at").alias("stay"))), "ppr")
            discard(state)
            state = masked
        if old is not None:
            discard(old)
        old = state
    if left:
        raise RuntimeError(f"PageRank did not settle in {max_rounds} rounds")
    out = alone.select("src", "dst", (F.col("src") == F.col("dst")).cast("double").alias("score"))
    out = out.unionByName(links.where("src is null").select("src", "dst", F.lit(0.0).alias("score")))
    for p in parts:
        out = out.unionByName(p)
    return out


def ppr_push(roots: DataFrame, edges: DataFrame, restart: float, eps: float, k: int, max_rounds: int = 50, cut_every: int = 4) -> DataFrame:
    """H07. (root, node, score, rank): approximate PageRank by rounds of residual pushes: every node whose residual is at
    least restart * eps * degree keeps the restart share and spreads the rest, until none is; the best ``k`` of each root.
    It is an error if ``max_rounds`` do not do."""
    step = stash(_transition(edges), "transition")
    deg = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    state = roots.select("root", F.col("root").alias("node"), F.lit(0.0).alias("p"), F.lit(1.0).alias("r"))
    old = []
    over = F.col("r") >= restart * eps * F.greatest(F.coalesce("deg", F.lit(1)), F.lit(1))
    for i in range(1, max_rounds + 1):
        ready = state.join(deg, "node", "left").withColumn("_push", over)
        kept = ready.select("root", "node", (F.col("p") + F.when(F.col("_push"), restart * F.col("r")).otherwise(0.0)).alias("p"), F.when(F.col("_push"), 0.0).otherwise(F.col("r")).alias("r"))
        spread = ready.where("_push").join(step, "node").select("root", F.col("_to").alias("node"), F.lit(0.0).alias("p"), ((1 - restart) * F.col("r") * F.col("_p")).alias("r"))
        state = kept.unionByName(spread).groupBy("root", "node").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        if i % cut_every == 0 or i == max_rounds:
            state = stash(state, "push")
            discard(*old)
            old = [state]
            if state.join(deg, "node", "left").where(over).limit(1).count() == 0:
                break
    else:
        raise RuntimeError(f"residuals did not settle in {max_rounds} rounds")
    ranked = state.where("p > 0").withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("p"), "node")))
    return ranked.where(F.col("rank") <= k).select("root", "node", F.col("p").alias("score"), "rank")


def ppr_normalise(scores: DataFrame, edges: DataFrame, how: str = "row") -> DataFrame:
    """H08. Scores as they are (row), or scaled by the degrees: col divides by that of the node and multiplies by that
    of the root, sym uses their square roots."""
    if how == "row":
        return scores
    d = edges.groupBy(F.col("src").alias("_n")).agg(F.count(F.lit(1)).cast("double").alias("_d"))
    both = scores.join(d.toDF("root", "_dr"), "root").join(d.toDF("node", "_dn"), "node")
    f = F.sqrt("_dr") / F.sqrt("_dn") if how == "sym" else F.col("_dr") / F.col("_dn")
    return both.withColumn("score", F.col("score") * f).select(*scores.columns)


def ppr_truncated(roots: DataFrame, edges: DataFrame, order: int, damping: float, size: int) -> DataFrame:
    """H09. (root, node, rank): ``order`` steps of x = (1 - damping) * r + damping * P x, scores over degree, the root
    first, at most ``size`` nodes."""
    step = _transition(edges)
    deg = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    home = roots.select("root", F.col("root").alias("node"), F.lit(1 - damping).alias("mass"))
    cur = roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("mass"))
    for _ in range(order):
        moved = cur.join(step, "node").select("root", F.col("_to").alias("node"), (damping * F.col("mass") * F.col("_p")).alias("mass"))
        cur = moved.unionByName(home).groupBy("root", "node").agg(F.sum("mass").alias("mass"))
    scored = cur.join(deg, "node", "left").withColumn("s", F.round(F.col("mass") / (F.coalesce("deg", F.lit(0)) + 1e-9), 12))
    w = Window.partitionBy("root").orderBy((F.col("node") == F.col("root")).desc(), F.desc("s"), "node")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).select("root", "node", "rank")


def row_rank(values: DataFrame, k: int) -> DataFrame:
    """H10. (row, col, rank): ranks from 1 of the k largest non-zero values of each row."""
    w = Window.partitionBy("row").orderBy(F.desc("value"), "col")
    return values.where("value <> 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("row", "col", "rank")


def ranked_neighbours(found: DataFrame, scores: DataFrame, k: int, pad: int = -1) -> DataFrame:
    """H11. (root, nodes): the k best-scored nodes of each root's ball without the root, unscored ones last by id,
    padded to k."""
    both = found.where("hop > 0").join(scores, ["root", "node"], "left")
    w = Window.partitionBy("root").orderBy(F.col("score").desc_nulls_last(), "node")
    top = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    lists = top.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("nodes"))
    roots = found.where("hop = 0").select("root")
    none = F.array().cast("array<bigint>")
    return roots.join(lists, "root", "left").select("root", F.slice(F.concat(F.coalesce("nodes", none), F.array_repeat(F.lit(pad).cast("long"), k)), 1, k).alias("nodes"))


def end_distances(links: DataFrame, edges: DataFrame, hops: int, block: bool) -> DataFrame:
    """(src, dst, node, ds, dd): distances of the nodes within ``hops`` of either end; null beyond. With ``block`` each
    search may not enter the other end."""
    keys = ["src", "dst"]
    one = lambda end, other: khop(links.select(*keys, F.col(end).alias("node")), edges, hops, keys, links.select(*keys, F.col(other).alias("node")) if block else None)
    a, b = one("src", "dst").withColumnRenamed("hop", "ds"), one("dst", "src").withColumnRenamed("hop", "dd")
    return a.join(b, [*keys, "node"], "full")


def drnl(links: DataFrame, edges: DataFrame, hops: int, max_dist: int = 100) -> DataFrame:
    """H12. (src, dst, node, label): 1 + min + (d // 2) * (d // 2 + d % 2 - 1) with d the sum of the two distances,
    capped and each with the other end removed; 1 for the ends."""
    d = end_distances(links, edges, hops, True)
    far = lambda c: F.least(F.coalesce(c, F.lit(max_dist)), F.lit(max_dist))
    x, y = far("ds"), far("dd")
    half, odd = F.floor((x + y) / 2), (x + y) % 2
    end = (F.col("node") == F.col("src")) | (F.col("node") == F.col("dst"))
    return d.select("src", "dst", "node", F.when(end, 1).otherwise(1 + F.least(x, y) + half * (half + odd - 1)).cast("long").alias("label"))


def contiguous_labels(labels: DataFrame) -> DataFrame:
    """H12. Labels replaced by 0..n-1 in their order. One row for each distinct label is ranked."""
    w = Window.orderBy("label")
    ids = labels.select("label").distinct().withColumn("idx", F.row_number().over(w) - 1)
    return labels.join(F.broadcast(ids), "label").drop("label")


def distance_encoding(links: DataFrame, edges: DataFrame, hops: int, max_dist: int = 3, plus: bool = False) -> DataFrame:
    """H13. (src, dst, node, ds, dd), capped; unreached distances are the cap, plus one without ``plus``. With ``plus``
    the other end is masked in each search, and each end is at 1 from the other."""
    d = end_distances(links, edges, hops, plus)
    cap = lambda c: F.least(F.coalesce(c, F.lit(max_dist if plus else max_dist + 1)), F.lit(max_dist if plus else max_dist + 1))
    ds, dd = cap("ds"), cap("dd")
    if plus:
        ds = F.when(F.col("node") == F.col("dst"), 1).otherwise(ds)
        dd = F.when(F.col("node") == F.col("src"), 1).otherwise(dd)
    return d.select("src", "dst", "node", ds.alias("ds"), dd.alias("dd"))


def simple_labels(ball: DataFrame, degrees: DataFrame, cap: int = 100) -> DataFrame:
    """H14. (root, node, hop, zero_one, degree): distance, whether it is the root, degree up to ``cap``."""
    return ball.join(degrees.select(F.col("id").alias("node"), "degree"), "node", "left").select(
        "root", "node", "hop", (F.col("hop") == 0).cast("int").alias("zero_one"), F.least(F.coalesce("degree", F.lit(0)), F.lit(cap)).alias("degree")
    )


def select_demos(rows: DataFrame, n: int, by_degree: bool) -> DataFrame:
    """H15. The first, or the highest-degree, ``n`` train rows of each class."""
    order = ([F.desc("degree")] if by_degree else []) + [F.col("id")]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("rn") <= n).drop("rn")
