"""Steps whose cost or memory once grew faster than their input."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import skew
from loomgraph.operators import edges as E
from loomgraph.operators import logs as L
from loomgraph.operators import reduction as R
from loomgraph.operators import vectors as V


def test_svd_passes_over_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 70, 9))) for i in range(300)], "id long, text string").repartition(3)
    passes, each, once = [], R._gram_times, R._gram
    monkeypatch.setattr(R, "_gram_times", lambda *a: passes.append("round") or each(*a))
    monkeypatch.setattr(R, "_gram", lambda *a: passes.append("once") or once(*a))
    _, values = R.tfidf_svd(docs, 6)
    assert passes == ["once"]
    monkeypatch.setattr(R, "PAIRED", 10)
    _, rounds = R.tfidf_svd(docs, 6)
    assert len(passes) > 2 and np.allclose(values, rounds, rtol=1e-9)


def plain_top_k(rows, k):
    """(id, other) -> (sim, rank) by plain loops."""
    out = {}
    for i, x in rows:
        sims = []
        for j, y in rows:
            if i != j:
                dot = lambda a, b: sum(p * q for p, q in zip(a, b))
                sims.append((-round(dot(x, y) / (dot(x, x) ** 0.5 * dot(y, y) ** 0.5), 9), j))
        for at, (s, j) in enumerate(sorted(v for v in sims if v[0] < 0)[:k]):
            out[i, j] = (-s, at + 1)
    return out


@pytest.mark.parametrize("block", [9, 4_096])
def test_top_k_by_matrix_products(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 5))
    rows = [(i, [float(v) for v in base[i]]) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200 + i, [2 * v for v in rows[5][1]]) for i in range(4)]  # copies and ties
    df = spark.createDataFrame(rows, "id long, x array<double>")
    plan = V.cosine_top_k(df, 3, block)
    assert "zip_with" not in plan._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]  # no dot product of a pair in the JVM
    got = {(r.id, r.other): (r.sim, r["rank"]) for r in plan.collect()}
    want = plain_top_k(rows, 3)
    assert got.keys() == want.keys() and all(abs(got[p][0] - want[p][0]) < 2e-9 and got[p][1] == want[p][1] for p in want)
    odd = df.unionByName(spark.createDataFrame([(900, [0.0] * 5), (901, None), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [1.0, 2.0])], "id long, x array<double>"))
    assert {(r.id, r.other): r["rank"] for r in V.cosine_top_k(odd, 3, block).collect()} == {p: v[1] for p, v in want.items()}
    named = {(r.id, r.other): r["rank"] for r in V.cosine_top_k(df.withColumn("id", F.format_string("n%03d", "id")), 3, block).collect()}
    assert named == {(f"n{i:03d}", f"n{j:03d}"): v[1] for (i, j), v in want.items()}


def test_resampled_ratings_fold_each_round_in_md5_order(spark):
    rng = np.random.default_rng(4)
    votes = [(i, f"m{a}", f"m{b}", w) for i, (a, b, w) in enumerate(zip(rng.integers(0, 5, 80), rng.integers(0, 5, 80), rng.choice(["model_a", "model_b", "tie"], 80)))]
    votes = [(i, a, b, str(w)) for i, a, b, w in votes]
    total, term, cdf = 0.0, math.e ** -1, []
    for i in range(8):
        total += term
        cdf.append(total)
        term /= i + 1
    seen = {}
    for r in range(1, 13):
        keyed = sorted((hashlib.md5(f"7|{r}|{v[0]}".encode()).hexdigest(), v) for v in votes)
        drawn = [v[1:] for h, v in keyed for _ in range(sum(int(h[:8], 16) / 2**32 > c for c in cdf))]
        for m, x in L.elo_steps(drawn).items():
            seen.setdefault(m, []).append(x)
    df = spark.createDataFrame(votes, "vote_id long, model_a string, model_b string, win string").repartition(3)
    plan = L.elo_bootstrap(df, 12, 7)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Generate") == 1  # no row for each copy of a vote
    for r in plan.collect():
        assert np.allclose([r.lower, r.rating, r.upper], np.percentile(seen.pop(r.model), [2.5, 50, 97.5]), rtol=1e-12)
    assert not seen


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    links = spark.range(900).select((F.col("id") % 180).alias("k"), F.expr("id * 7 % 41").alias("n"))
    got = E.bipartite_projection(links, "k", "n", 2)
    assert got.rdd.getNumPartitions() > 4  # the session has 4
    rows = [(r.k, r.n) for r in links.collect()]
    want = {}
    for k in range(180):
        own = sorted({n for q, n in rows if q == k})
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.src, r.dst): r.weight for r in got.collect()} == {p: w for p, w in want.items() if w > 1}
    edges = links.select(F.col("k").alias("src"), F.col("n").alias("dst"), F.lit(1).alias("weight"))
    wide, plain = E.to_undirected(edges, "sum", 900), E.to_undirected(edges, "sum")
    assert wide.rdd.getNumPartitions() == 18 and sorted(wide.collect()) == sorted(plain.collect())


def test_two_blocks_of_one_set_meet_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 3))
    a = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    parts = R._block_pairs(a, a, 10, lambda p, q: float((p @ q.T).sum())).collect()
    assert len(parts) <= 15 and sum(r.n for r in parts) == 2_500  # of 25 pairs of blocks
    assert np.isclose(sum(r.s for r in parts), (x @ x.T).sum())


def test_gaussian_kernels_by_squaring():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 5)), rng.normal(0.5, 1, size=(30, 5))
    x[3] = y[4]
    room = np.empty((2, 40 * 30))
    for scale in (0, 1e-3, 1, 30, 1e4):  # from one value for all to exponentials that vanish
        d = ((x[:, None] - y[None]) ** 2).sum(axis=2) * scale**2
        got = R._gaussians(*R._halves(x * scale, y * scale, 8.0), 5, room)
        assert np.isclose(got, sum(np.exp(-d * f / 8.0).sum() for f in (1, 2, 4, 8, 16)), rtol=1e-11, atol=0 if scale < 1e4 else 1e-3)


def test_blocks_travel_packed(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4))
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, x array<double>")
    for m, size in ((x, 8), (x.astype(np.float32), 4)):  # single precision only where nothing is lost
        rows = R._packed(frame(m).coalesce(1), 3).collect()
        assert len(rows) == 3 and sum(r.n for r in rows) == 500 and all(len(r.v) == r.n * r.dim * size for r in rows)
        got = np.concatenate([np.frombuffer(r.v, f"f{size}").reshape(r.n, r.dim) for r in rows])
        assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, m.tolist()))
    a, b = frame(x), frame(x[:70].astype(np.float32))
    assert np.isclose(R._block_pairs(a, b, 60, lambda p, q: float((p @ q.T).sum())).agg(F.sum("s")).first()[0], x.sum(axis=0) @ x[:70].astype(np.float32).astype(float).sum(axis=0))
    odd = spark.createDataFrame([(i, None if i == 1 else [1.0] * 4) for i in range(4)], "id long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="a vector is null"):  # 12 numbers are no 4 vectors of 3
        R.mmd_bandwidth(odd, b)
