"""Golden cases and invariants of the graph operators, beside the comparisons with DuckDB."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.fixpoint import connected_components
from loomgraph.functions.ranking import global_rank, seeded_rank
from loomgraph.operators import edges as E
from loomgraph.operators import heuristics as H
from loomgraph.operators import logs as L
from loomgraph.operators import metrics as M
from loomgraph.operators import paths as P
from loomgraph.operators import sampling as N
from loomgraph.operators import sketches as K
from loomgraph.operators import splits as S
from loomgraph.plans import fixtures as X
from loomgraph.plans import path_queries


def edges(spark, *pairs, both=True):
    rows = [(a, b, 1) for a, b in pairs] + ([(b, a, 1) for a, b in pairs] if both else [])
    return spark.createDataFrame(rows, "src long, dst long, weight long")


def test_components(spark):
    e = edges(spark, (1, 2), (2, 3), (5, 6), (7, 7), *[(100 + i, 101 + i) for i in range(40)], both=False)
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7} | {100 + i: 100 for i in range(41)}
    assert connected_components(e.limit(0)).count() == 0
    star = edges(spark, *[(0, i) for i in range(1, 300)], both=False)
    assert {r.component for r in connected_components(star).collect()} == {0}


def test_undirected_is_idempotent(spark):
    e = edges(spark, (1, 2), (2, 1), (3, 3), both=False)
    once = E.to_undirected(e)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, E.to_undirected(once.withColumn("w", F.lit(1)).drop("w")).collect())) == [(1, 2), (2, 1), (3, 3)]


def test_row_rank_golden(spark):
    rows = [[5, 3, 2, 10, 1], [0, 8, 0, 4, 0], [3, 0, 0, 6, 7]]
    df = spark.createDataFrame([(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "row int, col int, value int")
    got = {(r["row"], r["col"]): r["rank"] for r in P.row_rank(df, 3).collect()}
    want = [[2, 3, 0, 1, 0], [0, 1, 0, 2, 0], [3, 0, 0, 2, 1]]
    assert got == {(i, j): v for i, r in enumerate(want) for j, v in enumerate(r) if v}


def test_structured_feasibility_golden(spark):
    e = edges(spark, (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 1), both=False)
    assert not N.structured_feasible(e, 3).first().feasible and N.structured_feasible(e, 3, loops=True).first().feasible


def test_negatives_are_no_edges(spark):
    e = edges(spark, (0, 0), (0, 1), (1, 2), (2, 3), both=False)
    got = [tuple(r) for r in N.negative_edges(e, 4, 4, over=20.0).collect()]
    assert len(got) <= 4 and not {(0, 0), (0, 1), (1, 2), (2, 3)} & set(got) and all(a != b for a, b in got)


def test_complement_negatives_of_many_nodes(spark):
    nodes = spark.range(5_200)
    e = edges(spark, *[(0, i) for i in range(1, 5_200)], both=False)
    got = [tuple(r) for r in N.complement_negatives(e, nodes, 30, 4).collect()]
    assert len(set(got)) == 30 and all(0 < a < b for a, b in got)
    # few free pairs: the bound has to rise to all pairs
    few = edges(spark, *[(a, b) for a in range(12) for b in range(a + 1, 12) if (a, b) not in ((2, 7), (5, 6))], both=False)
    assert {tuple(r) for r in N.complement_negatives(few, spark.range(12), 5).collect()} == {(2, 7), (5, 6)}
    # one order for every k: a larger k goes on where a smaller one stops, through the draws and then the rest
    known = {(0, 1), (3, 4)}
    e = edges(spark, *known, both=False)
    free = {(a, b) for a in range(10) for b in range(a + 1, 10)} - known
    runs = {k: [tuple(r) for r in N.complement_negatives(e, spark.range(10), k, 9).collect()] for k in (5, 21, 22, 40, 43, 99)}
    for k, got in runs.items():
        assert len(got) == len(set(got)) == min(k, 43) and set(got) <= free
        assert all(set(runs[j]) <= set(got) for j in runs if j < k)
    draw = lambda side, i: int(hashlib.md5(f"9-{side}|{i}".encode()).hexdigest()[:8], 16) % 10
    want = dict.fromkeys(p for i in range(200) if (p := tuple(sorted((draw("a", i), draw("b", i))))) in free)
    assert set(runs[21]) == set(list(want)[:21])


def test_negatives_are_complete(spark):
    # all but a few pairs are linked: draws alone would miss the rest
    n = 12
    free = {(2, 7), (7, 2), (5, 6)}
    e = edges(spark, *[(a, b) for a in range(n) for b in range(n) if a != b and (a, b) not in free], both=False)
    assert {tuple(r) for r in N.negative_edges(e, n, 9, 1).collect()} == free
    assert len(N.negative_edges(e, n, 2, 1).collect()) == 2
    got = N.structured_negatives(e, n, 2).collect()
    assert len(got) == n * (n - 1) - 3 and {(r.src, r.neg) for r in got if r.neg is not None} == free
    assert all(r.neg is None for r in got if r.src not in (2, 5, 7))
    hub = edges(spark, *[(0, i) for i in range(1, n - 1)])
    far = {r.root: r.neg for r in N.far_negative(spark.createDataFrame([(0,), (3,)], "root long"), hub, n, 2, 1).collect()}
    assert far == {0: 11, 3: 11}
    assert N.far_negative(spark.createDataFrame([(0,)], "root long"), hub, n - 1, 2, 1).first().neg is None
    g = e.withColumn("graph_id", F.lit(1)).unionByName(e.where("false").withColumn("graph_id", F.lit(2)))
    nodes = spark.createDataFrame([(1, i) for i in range(n)] + [(2, 8), (2, 9), (3, 4)], "graph_id int, id long")
    got = [tuple(r) for r in N.batched_negatives(g, nodes, 4).collect()]
    assert {r[1:] for r in got if r[0] == 1} == free and {r[1:] for r in got if r[0] == 2} == {(8, 9), (9, 8)} and len(got) == 5


def test_drnl_values(spark):
    # 0 - 1 is the link, 2 is next to both, 3 next to 2
    e = edges(spark, (0, 1), (0, 2), (1, 2), (2, 3))
    got = {r.node: r.label for r in P.drnl(spark.createDataFrame([(0, 1)], "src long, dst long"), e, 3).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 5}


def test_ppr_mass(spark):
    e = edges(spark, (0, 1), (1, 2), (2, 0), (3, 4))
    roots = spark.createDataFrame([(0,), (3,)], "root long")
    pushed = P.ppr_push(roots, e, 0.2, 1e-4, 10)
    assert all(0.9 < r.m <= 1.0 + 1e-9 for r in pushed.groupBy("root").agg(F.sum("score").alias("m")).collect())
    exact = P.ppr_power(spark.createDataFrame([(0, 1), (0, 2), (0, 3), (3, 4)], "src long, dst long"), e, damping=0.8)
    got = {(r.src, r.dst): r.score for r in exact.collect()}
    assert got[0, 3] == 0 and abs(got[3, 4] - 0.8 / 1.8) < 1e-4 and abs(got[0, 1] - got[0, 2]) < 1e-6
    near = {(r.root, r.node): r.score for r in pushed.collect()}
    assert abs(near[0, 1] - got[0, 1]) < 1e-2


def test_ppr_queries_against_dense_solve(spark, monkeypatch):
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4)]
    e = edges(spark, *pairs)
    monkeypatch.setattr(X, "graph", lambda s, d: e)
    monkeypatch.setattr(X, "pairs", lambda s, d: e.where("src < dst"))
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    p = np.zeros((len(ids), len(ids)))
    for a, b in pairs:
        p[at[a], at[b]] = p[at[b], at[a]] = 1
    deg = p.sum(axis=1)
    p /= deg[:, None]
    exact = lambda restart: restart * np.linalg.inv(np.eye(len(ids)) - (1 - restart) * p)
    power, want = path_queries.BOOK.queries["h06_ppr_power"](spark, "").collect(), exact(0.15)
    assert len(power) == len(pairs) and all(abs(r.score - want[at[r.src], at[r.dst]]) < 2e-6 for r in power)
    # a push leaves less than restart * eps * degree at each node, so each score is short by less than that
    pushed, want = path_queries.BOOK.queries["h07_ppr_push_topk"](spark, "").collect(), exact(0.25)
    assert len({r.root for r in pushed}) == len(ids)
    for r in pushed:
        assert -1e-6 <= want[at[r.root], at[r.node]] - r.score <= 1e-3 * 0.25 * deg[at[r.node]] + 1e-6
    roots = e.select(F.col("src").alias("root")).distinct()
    with pytest.raises(RuntimeError):
        P.ppr_power(e.select("src", "dst"), e, max_rounds=10)
    with pytest.raises(RuntimeError):
        P.ppr_push(roots, e, 0.25, 1e-3, 10, max_rounds=4)


def test_intersections_of_all_hops(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (6, 7)]
    e, nodes, slots = edges(spark, *pairs), spark.range(8), 1_024
    ball = {i: {1: {i} | {b for p in pairs for a, b in (p, p[::-1]) if a == i}} for i in range(8)}
    for b in ball.values():
        b[2] = set().union(*(ball[x][1] for x in b[1]))
    hashes = K.minhash_neighbourhoods(K.minhash(nodes, slots), e, 2)
    got = {(r.src, r.dst, r.k1, r.k2): r.n for r in K.intersections(e.where("src < dst").select("src", "dst"), hashes, K.hll_neighbourhoods(e, nodes, 2), slots).collect()}
    assert set(got) == {(a, b, i, j) for a, b in pairs for i in (1, 2) for j in (1, 2)}
    assert all(abs(n - len(ball[a][i] & ball[b][j])) < 0.6 for (a, b, i, j), n in got.items())


def test_heuristics_without_edges(spark):
    e = edges(spark, (1, 2)).limit(0)
    links = spark.createDataFrame([(1, 2)], "src long, dst long")
    for f in (H.common_neighbours, H.adamic_adar, H.resource_allocation):
        assert [r.score for r in f(links, e).collect()] == [0.0]


def test_splits_are_disjoint_and_complete(spark):
    rows = spark.range(101).select("id", (F.col("id") % 3).alias("label"))
    one = S.ratio_split(rows, (0.6, 0.2, 0.2), 5)
    counts = {r.split: r["count"] for r in one.groupBy("split").count().collect()}
    assert counts == {"train": 60, "valid": 20, "test": 21} and one.select("id").distinct().count() == 101
    with pytest.raises(ValueError):
        S.ratio_split(rows, (0.6, 0.2, 0.3))
    assert [r.rn for r in global_rank(rows, [F.col("id")]).orderBy("id").collect()] == list(range(1, 102))
    assert sorted(r.rn for r in seeded_rank(rows.limit(7), 1, "id").collect()) == list(range(1, 8))
    assert global_rank(rows.limit(0), [F.col("id")]).count() == 0


def test_metrics_one_class_and_ties(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 5, 1), (2, None, 1), (2, 3, None)], "task int, score int, y int")
    got = {r.task: r.auc for r in M.roc_auc(df, ["task"]).collect()}
    assert got == {0: 0.5, 1: None}
    assert M.hits_at_k(df.where("task = 0"), [5], []).first().hits_5 == 1.0


def test_elo_fold_and_boards(spark):
    r = L.elo_fold(["a", "a"], ["b", "b"], ["model_a", "tie"])
    assert abs(r["a"] + r["b"] - 2000) < 1e-9 and abs(r["a"] - (1002 + 4 * (0.5 - 1 / (1 + 10 ** ((998 - 1002) / 400))))) < 1e-9
    df = spark.createDataFrame([("x", 1, "a", "b", "model_a"), ("y", 1, "a", "b", "model_b"), ("x", 2, "a", "b", "tie")], "board string, t int, model_a string, model_b string, win string")
    got = {(q.board, q.model): q.rating for q in L.elo(df, "board", ["t"]).collect()}
    assert abs(got["x", "a"] - r["a"]) < 1e-9 and got["y", "a"] == 998.0


def test_elo_streams_many_boards(spark):
    votes = [(i % 3, (i * 7) % 5_000, i, f"m{i % 4}", f"m{(i + 1 + i % 2) % 4}", ["model_a", "model_b", "tie"][i * i % 3]) for i in range(6_000)]
    df = spark.createDataFrame(votes, "board int, t int, i int, model_a string, model_b string, win string").repartition(5)
    out = L.elo(df.coalesce(2), "board", ["t", "i"])
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no board is one frame
    got = {(r.board, r.model): r.rating for r in out.collect()}
    for board in range(3):
        own = sorted((v for v in votes if v[0] == board), key=lambda v: v[1:3])
        want = L.elo_fold(*zip(*[v[3:] for v in own]))
        assert {m: got[str(board), m] for m in want} == want
    assert len(got) == 12
