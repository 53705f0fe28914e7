"""Joins on hot keys, ranks without a one-task window, components and stored tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import ranking, storage
from loomgraph.functions.columns import unused
from loomgraph.functions.fixpoint import connected_components
from loomgraph.functions.skew import HOT_KEYS, join_by_count
from loomgraph.operators import metrics as M
from loomgraph.operators import sampling as N
from loomgraph.operators import splits as P


def test_join_by_count_broadcasts_hot_keys_only(spark):
    keys = [7] * 4_000 + [None] * 10 + list(range(2_000))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("low"))
    out = join_by_count(rows, per, ["k"], len(keys))
    assert out.columns == ["k", "i", "low"]
    low = {}
    for i, k in enumerate(keys):
        low.setdefault(k, i)
    assert sorted(tuple(r) for r in out.collect()) == sorted((k, i, low[k]) for i, k in enumerate(keys) if k is not None)
    assert per.where(F.col("n") * HOT_KEYS > len(keys)).count() == 2  # 7 and null
    some = join_by_count(rows, per.where("k < 10").select("k", "n"), ["k"], len(keys), how="left_semi")
    assert some.columns == ["k", "i"] and some.count() == 4_010


def test_ranks_of_any_group_size(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label string, v long").repartition(7)
    got = {r.id: r.rn for r in ranking.wide_group_rank(df, ["label"], [F.col("v"), F.col("id")]).collect()}
    for label in ("a", "b", None):
        own = sorted((v, i) for i, x, v in rows if x == label)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert [r.id for r in sorted(ranking.first_rows(df, [F.col("v"), F.col("id")], 20).collect(), key=lambda r: (r.v, r.id))] == [i for _, i in sorted((v, i) for i, _, v in rows)[:20]]
    assert ranking.wide_group_rank(df.limit(0), ["label"], [F.col("id")]).count() == 0
    named = df.withColumnsRenamed({"v": "own", "label": "pid"})
    assert ranking.wide_group_rank(named, ["pid"], [F.col("own"), F.col("id")]).columns == ["id", "pid", "own", "rn"]


def test_running_sums_and_rank_metrics_without_groups(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300) / 7, rng.randrange(2)) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "score double, y int").repartition(5)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df, []).first().auc - want) < 1e-12
    tp = fp = 0
    ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        here = pos.count(s)
        tp, fp = tp + here, fp + neg.count(s)
        ap += here / len(pos) * tp / (tp + fp)
    assert abs(M.average_precision(df, []).first().ap - ap) < 1e-12
    bound = sorted(neg, reverse=True)[49]
    assert abs(M.hits_at_k(df, [50], []).first().hits_50 - sum(p > bound for p in pos) / len(pos)) < 1e-12
    summed = ranking.wide_running_sums(spark.createDataFrame([("a", 1, 5), ("a", 2, 7), (None, 1, 1)], "g string, o int, v int"), ["g"], [F.col("o")], {"s": "v"})
    assert sorted((r.g or "", r.o, r.s) for r in summed.collect()) == [("", 1, 1), ("a", 1, 5), ("a", 2, 12)]


def test_components_of_hubs_chains_and_loops(spark):
    edges = [(5_000, i) for i in range(6_000, 6_400)] + [(9_000 + i, 9_001 + i) for i in range(40)] + [(1, None), (99, 99), (3, 2), (2, 3), (2, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = {5_000: 5_000, 99: 99, 2: 2, 3: 2} | {i: 5_000 for i in range(6_000, 6_400)} | {9_000 + i: 9_000 for i in range(41)}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def test_bucketed_tables_open_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = storage.stash_bucketed(spark.range(100).selectExpr("id AS k", "id % 3 AS v"), ["k"], buckets=3, path=path)
    b = storage.open_bucketed(spark, path, "k bigint, v bigint", ["k"], 3)
    plan = a.join(b.hint("merge"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and a.join(b, "k").count() == 100
    storage.discard(a)
    assert storage.folders(spark, path) == []
    assert unused(["A", "b"], "a", "b", "b") == ["a_", "b_", "b__"]


def test_group_splits_fold_in_order(spark):
    sizes = {"a": 50, "b": 30, "c": 15, "d": 4, "e": 1}
    rows = spark.createDataFrame([(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)], "id string, grp string")
    got = {r.grp: r.split for r in P.group_greedy_split(rows, "grp", (0.6, 0.3)).distinct().collect()}
    assert got == {"a": "train", "b": "valid", "c": "test", "d": "train", "e": "train"}
    out = P.group_random_split(rows, "grp", (0.6, 0.3, 0.1), 3)
    assert out.count() == 100 and out.groupBy("grp").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert P.sample_rows(rows, 0.25, 1).count() == 25


@pytest.mark.parametrize("k", [3, 9, 40])
def test_complement_negatives(spark, k):
    nodes = spark.createDataFrame([(10 * i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(0, 10), (10, 0), (20, 30), (70, 0)], "src long, dst long")
    got = [(r.src, r.dst) for r in N.complement_negatives(edges, nodes, k, 1).collect()]
    assert len(got) == len(set(got)) == min(k, 28 - 3) and all(a < b for a, b in got)
    assert not set(got) & {(0, 10), (20, 30), (0, 70)}
