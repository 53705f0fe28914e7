"""Samplers whose memory or time once grew faster than their input, and ranks in narrow groups."""

from pyspark.sql import functions as F

from loomgraph.functions import ranking
from loomgraph.operators import augment as G
from loomgraph.operators import sampling as N


def test_negatives_between_groups_without_the_linked_pairs(spark):
    t = spark.range(60).select("id", (F.col("id") % 5).alias("g"))
    linked = t.toDF("src", "g").join(t.toDF("dst", "g"), "g").where("src < dst").select("src", "dst")
    for k in (40, 5_000):  # more than there are
        want = sorted(N.complement_negatives(linked, t, k, 3).collect())
        got = sorted(N.complement_negatives(None, t, k, 3, "g").collect())
        assert got == want and len(got) == min(k, 1_440)


def test_anchored_episodes_rank_no_row_for_each_query_and_class(spark):
    rows = spark.range(90).select("id", F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), F.col("id") % 7)).alias("label"))
    out = N.anchored_episodes(rows, rows, 3, 2, 1)
    assert '"query_id' not in out._jdf.queryExecution().executedPlan().toString() and "Window [row_number() windowspecdefinition(query_id" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    label = {r.id: r.label for r in rows.collect()}
    assert len(got) == 6 * sum(v is not None for v in label.values())
    for r in got:
        assert r.id != r.query_id and label[r.id] == r.label and (r.way > 0) == (r.label != label[r.query_id])


def test_narrow_groups_are_ranked_as_wide_ones(spark, monkeypatch):
    nodes = spark.range(80).select((F.col("id") % 9).alias("graph_id"), "id").withColumn("x", F.array(F.col("id").cast("double")))
    assert ranking.rank_for(["graph_id"], nodes) is ranking.group_rank
    edges = nodes.select("graph_id", F.col("id").alias("src"), ((F.col("id") + 9) % 81).alias("dst"))
    run = lambda: [sorted(t.select(*sorted(t.columns)).collect()) for t in (G.noise_features(nodes, 0.6, 0.5, 1), G.grown_subset(nodes, edges, 0.6, 2, 2), N.batched_negatives(edges, nodes.drop("x"), 2, 5))]
    narrow = run()
    monkeypatch.setattr(ranking, "NARROW", 3)
    assert ranking.rank_for(["graph_id"], nodes) is ranking.wide_group_rank and run() == narrow
