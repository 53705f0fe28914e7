"""Queries of the remaining vector, episode, augmentation and extension rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import hooks as U
from loomgraph.functions.ranking import md5_bucket
from loomgraph.functions.storage import table
from loomgraph.operators import augment as G
from loomgraph.operators import sampling as N
from loomgraph.operators import splits as S
from loomgraph.operators import text as T
from loomgraph.operators import vectors as V
from loomgraph.operators.probe import probe
from loomgraph.plans import fixtures as X
from loomgraph.plans import metric_queries as MQ
from loomgraph.plans import path_queries as PQ
from loomgraph.plans.fixtures import bucket_sql, md5_sql, sql
from loomgraph.plans.path_queries import ORDERS, order_graphs, part_pairs, roots
from loomgraph.plans.source_queries import gnodes
from loomgraph.plans.text_queries import FE, LV, feats, r6

BOOK = X.Book()
add = BOOK.add


def bucket_sql_of_dim():
    """SQL of the bucket of each dimension, whose seed holds its number."""
    return "(('0x' || substr(md5('3-' || dim), 1, 8))::BIGINT % 100)"


_LP = {"lp": "SELECT src, dst FROM graph UNION ALL SELECT id, id FROM nodes", "ld": "SELECT src, count(*)::DOUBLE AS n FROM lp GROUP BY 1", "lw": "SELECT lp.src, lp.dst, 1 / sqrt(a.n * b.n) AS w FROM lp JOIN ld a ON a.src = lp.src JOIN ld b ON b.src = lp.dst"}
add("v03_sign_features", lambda s, d: r6(V.sign_features(feats(s, d), X.graph(s, d), X.nodes(s, d), 2), "val"),
    sql("SELECT 0 AS copy, id, dim, val FROM fe UNION ALL SELECT 1, id, dim, round(val, 6) FROM p UNION ALL SELECT 2, src, dim, round(sum(w * val), 6) FROM lw JOIN p ON id = dst GROUP BY 2, 3", "graph", "nodes", fe=FE, **_LP, p="SELECT src AS id, dim, sum(w * val) AS val FROM lw JOIN fe ON id = dst GROUP BY 1, 2"))
add("v10_smoothed_similarity", lambda s, d: V.smoothed_similarity(feats(s, d), V.row_weights(X.graph(s, d)), 1, part_pairs(s, d)).withColumn("cosine", F.round("cosine", 5)),
    sql("SELECT pr.src, pr.dst, round(sum(a.val * b.val) / sqrt(sum(a.val * a.val) * sum(b.val * b.val)), 5) AS cosine FROM pairs pr JOIN p a ON a.id = pr.src JOIN p b ON b.id = pr.dst AND a.dim = b.dim GROUP BY 1, 2", "graph", "nodes", fe=FE,
        rw="SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM graph", p="SELECT src AS id, dim, sum(w * val) AS val FROM rw JOIN fe ON id = dst GROUP BY 1, 2"))
add("v14_kmeans", lambda s, d: V.kmeans_clusters(X.vectors(s, d), 8, 1))
for _h, _e in (("dot", "list_dot_product(a.x, b.x)"), ("cosine", "list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x))"), ("euclidean", "-list_distance(a.x, b.x)")):
    add(f"v15_dataset_similarity_{_h}", lambda s, d, h=_h: r6(V.set_similarity(X.vectors(s, d).where("label < 5"), X.vectors(s, d).where("label >= 5"), h), "similarity"),
        sql(f"SELECT round(avg({_e}), 6) AS similarity FROM vectors a, vectors b WHERE a.label < 5 AND b.label >= 5", "vectors"))
add("v15_dataset_similarity_mmd", lambda s, d: r6(V.set_similarity(X.vectors(s, d).where("label < 5"), X.vectors(s, d).where("label >= 5"), "mmd"), "similarity"),
    sql("SELECT round(-(avg(k) FILTER (p AND q) - 2 * avg(k) FILTER (p AND NOT q) + avg(k) FILTER (NOT p AND NOT q)), 6) AS similarity FROM (SELECT p, q, " + " + ".join(f"exp(-e / (w * {f}))" for f in (0.25, 0.5, 1, 2, 4)) + " AS k FROM z2)", "vectors",
        z="SELECT a.label < 5 AS p, b.label < 5 AS q, list_distance(a.x, b.x) ** 2 AS e FROM vectors a, vectors b", z2="SELECT p, q, e, sum(e) OVER () / (count(*) OVER () - sqrt(count(*) OVER ())) AS w FROM z"))
add("v19_linear_probe", lambda s, d: V.linear_probe(X.vectors(s, d).where(md5_bucket("probe", "id", buckets=5) > 0), X.vectors(s, d)))
_U = lambda at: f"(('0x' || substr({md5_sql(2, 'id', 'dim')}, {at}, 8))::BIGINT + 1)::DOUBLE / 4294967297"
add("v20_random_vectors", lambda s, d: r6(V.random_vectors(X.nodes(s, d), 4, 2), "val"), sql(f"SELECT id, dim::INT AS dim, round(sqrt(-2 * ln({_U(1)})) * cos({_U(9)} * 6.283185307179586), 6) AS val FROM nodes, range(4) t(dim)", "nodes"))


def kinds(s, d):
    return X.nodes(s, d).select("id", F.col("kind").alias("label"))


add("n21_anchored_episode", lambda s, d: N.anchored_episodes(kinds(s, d), kinds(s, d), 3, 2, 1),
    sql(f"SELECT query_id, way - 1 AS way, label, id FROM (SELECT w.*, k.id, row_number() OVER (PARTITION BY query_id, w.label ORDER BY {md5_sql('1-row', 'k.id')}, k.id) AS rn FROM w JOIN k ON k.label = w.label AND k.id <> query_id WHERE way <= 3) WHERE rn <= 2", "nodes",
        k="SELECT id, kind AS label FROM nodes", e="SELECT label FROM k GROUP BY 1 HAVING count(*) > 2",
        w=f"SELECT k.id AS query_id, e.label, row_number() OVER (PARTITION BY k.id ORDER BY (e.label = k.label)::INT DESC, {md5_sql(1, 'k.id', 'e.label')}, e.label) AS way FROM k, e WHERE k.label IN (SELECT label FROM e)"))
add("n22_multiclass_task", lambda s, d: N.multiclass_shots(X.nodes(s, d).select("id", F.col("name").alias("label")), 40, 3),
    sql(f"SELECT label, i - 1 AS shot, id FROM (SELECT name AS label, id, row_number() OVER (PARTITION BY name ORDER BY {md5_sql(3, 'id')}, id) AS rn, count(*) OVER (PARTITION BY name) AS n FROM nodes) JOIN range(1, 41) t(i) ON (i - 1) % n + 1 = rn", "nodes"))
_STEP = "SELECT w.root, {t} AS step, n.dst AS node FROM {w} w JOIN dg ON dg.src = w.node JOIN nb n ON n.src = w.node AND n.i = ('0x' || substr({h}, 1, 8))::BIGINT % dg.n"
add("n23_self_supervised_tasks", lambda s, d: N.neighbour_tasks(N.random_walk(roots(s, d), X.graph(s, d), 3, 9), 3),
    sql("SELECT label, member FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY member) AS rn, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT root AS label, node AS member FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3))) WHERE n >= 3 AND rn <= 3", "graph",
        nb="SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i FROM graph", dg="SELECT src, count(*) AS n FROM graph GROUP BY 1", w0="SELECT DISTINCT src AS root, 0 AS step, src AS node FROM graph", **{f"w{t}": _STEP.format(t=t, w=f"w{t - 1}", h=md5_sql(f"9-{t}", "root")) for t in (1, 2, 3)}))

_IDX = "SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS pos, count(*) OVER (PARTITION BY graph_id) AS n FROM ln"
_DR = lambda c: f"('0x' || substr({md5_sql('1-' + c, 'graph_id', 'draw')}, 1, 8))::BIGINT"
add("g03_rewire_edges", lambda s, d: G.rewire_edges(gnodes(s, d), order_graphs(s, d)[0].select("graph_id", "src", "dst"), 0.4, 1),
    sql(f"SELECT graph_id, src, dst FROM r WHERE rn > floor(n * 0.4) UNION ALL SELECT q.graph_id, a.id, b.id FROM (SELECT graph_id, {_DR('a')} AS a, {_DR('b')} AS b FROM (SELECT DISTINCT graph_id, floor(n * 0.4)::INT AS k FROM r) JOIN range(1, 100) t(draw) ON draw <= k) q JOIN i a ON a.graph_id = q.graph_id AND a.pos = q.a % a.n + 1 JOIN i b ON b.graph_id = q.graph_id AND b.pos = q.b % b.n + 1",
        **ORDERS, i=_IDX, r=f"SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {md5_sql(1, 'graph_id', 'src', 'dst')}, src, dst) AS rn, count(*) OVER (PARTITION BY graph_id) AS n FROM oe"))
_x = lambda s, d: gnodes(s, d).withColumn("x", F.array((F.col("id") * 2).cast("double"), F.lit(1.0)))
_M = f"SELECT graph_id, id, rn <= floor(n * 0.6) AS mask FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {md5_sql(1, 'graph_id', 'id')}, id) AS rn, count(*) OVER (PARTITION BY graph_id) AS n FROM ln)"
add("g05_mask_with_noise", lambda s, d: G.noise_features(_x(s, d), 0.6, 0.5, 1).select("graph_id", "id", "mask", "noisy", F.col("x")[0].alias("x0")),
    sql(f"SELECT k.graph_id, k.id, mask, noisy, CASE WHEN noisy THEN o.id * 2 WHEN mask THEN 0 ELSE k.id * 2 END::DOUBLE AS x0 FROM (SELECT *, mask AND row_number() OVER (PARTITION BY graph_id, mask ORDER BY {md5_sql('1-noise', 'graph_id', 'id')}, id) <= floor(count(*) OVER (PARTITION BY graph_id, mask) * 0.5) AS noisy, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS p FROM m) k JOIN (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {md5_sql('1-pool', 'graph_id', 'id')}, id) AS p FROM ln) o ON o.graph_id = k.graph_id AND o.p = k.p", **ORDERS, m=_M))
_BI = lambda s, d: order_graphs(s, d)[0].select("graph_id", "src", "dst").unionByName(order_graphs(s, d)[0].select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
_G0 = f"SELECT graph_id, id, 0 AS round FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {md5_sql(2, 'graph_id', 'id')}, id) AS rn FROM ln) WHERE rn = 1"
_GR = "SELECT graph_id, id, round FROM (SELECT u.*, row_number() OVER (PARTITION BY u.graph_id ORDER BY round, {h}, u.id) AS rn FROM (SELECT * FROM {w} UNION ALL SELECT DISTINCT b.graph_id, b.dst, {r} FROM {w} w JOIN be b ON b.graph_id = w.graph_id AND b.src = w.id WHERE (b.graph_id, b.dst) NOT IN (SELECT (graph_id, id) FROM {w})) u) JOIN sz USING (graph_id) WHERE rn <= size"
add("g06_drop_feature_dims", lambda s, d: V.long_form(G.drop_dimensions(X.vectors(s, d), 64, 50, 3)),
    sql("SELECT id, dim, CASE WHEN " + bucket_sql_of_dim() + " >= 50 THEN val ELSE 0 END AS val FROM lv", "vectors", lv=LV))
add("n25_support_query_mark", lambda s, d: N.few_shot_episodes(kinds(s, d), 8, 3, 2, 2, 4).groupBy("episode", "way", "role").agg(F.count(F.lit(1)).alias("n")),
    sql("SELECT episode, way::INT AS way, role, 2 AS n FROM range(8) t(episode), range(3) w(way), (VALUES ('support'), ('query')) r(role)"))
add("g08_walk_subgraph_aug", lambda s, d: G.grown_subset(gnodes(s, d), _BI(s, d), 0.6, 2, 2),
    sql("SELECT graph_id, id FROM r2", **ORDERS, be="SELECT graph_id, src, dst FROM oe UNION ALL SELECT graph_id, dst, src FROM oe", sz="SELECT graph_id, greatest(floor(count(*) * 0.6), 1) AS size FROM ln GROUP BY 1", r0=_G0, **{f"r{r}": _GR.format(h=md5_sql(f"2-{r}", "u.graph_id", "u.id"), w=f"r{r - 1}", r=r) for r in (1, 2)}))
add("g09_mask_typed_nodes", lambda s, d: G.mask_typed_nodes(gnodes(s, d).withColumn("type", (F.col("id") % 4).cast("int")), 0.2, 1),
    sql(f"SELECT graph_id, id, (id % 4)::INT AS original, CASE WHEN rn <= floor(n * 0.2 + 1) THEN -1 ELSE id % 4 END::INT AS type FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {md5_sql(1, 'graph_id', 'id')}, id) AS rn, count(*) OVER (PARTITION BY graph_id) AS n FROM ln)", **ORDERS))
add("g10_neighbour_dropout", lambda s, d: G.blank_neighbours(X.graph(s, d).select(F.col("src").alias("id"), F.col("dst").alias("node")), 4, 60, 1, 3),
    sql(f"SELECT s.id, s.node, coalesce(b.o, s.rn = 1) AS kept FROM s LEFT JOIN (SELECT id, min(t) AS t FROM b WHERE o GROUP BY 1) g ON g.id = s.id LEFT JOIN b ON b.id = s.id AND b.node = s.node AND b.t = g.t", "graph",
        s="SELECT id, node, rn FROM (SELECT src AS id, dst AS node, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM graph) WHERE rn <= 4", b=f"SELECT id, node, t, {bucket_sql(1, 'id', 'node', 't', buckets=100)} >= 60 AS o FROM s, range(3) r(t)"))
_EP = f"SELECT episode, way - 1 AS way, id, CASE WHEN rn <= 3 THEN 'support' ELSE 'query' END AS role FROM (SELECT w.*, n.id, row_number() OVER (PARTITION BY episode, w.label ORDER BY {md5_sql('1-row', 'episode', 'n.id')}, n.id) AS rn FROM w JOIN nodes n ON n.kind = w.label WHERE way <= 4) WHERE rn <= 8"
add("g13_episode_metagraph", lambda s, d: G.episode_metagraph(N.few_shot_episodes(kinds(s, d), 12, 4, 3, 5, 1)),
    sql("SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY way, role, id) - 1 AS src, count(*) OVER (PARTITION BY episode) + way AS dst, CASE WHEN role = 'support' THEN 2 ELSE 4 END AS type FROM ep", "nodes",
        w=f"SELECT episode, kind AS label, row_number() OVER (PARTITION BY episode ORDER BY {md5_sql('1-way', 'episode', 'kind')}, kind) AS way FROM range(12) t(episode), (SELECT kind FROM nodes GROUP BY 1 HAVING count(*) >= 8)", ep=_EP))
add("g15_typed_link_subgraph", lambda s, d: G.typed_link_subgraph(order_graphs(s, d)[0].select(F.col("graph_id").alias("sample_id"), "src", "dst", F.col("src").alias("type")), 10),
    sql("SELECT graph_id AS sample_id, src, dst, src AS type FROM oe UNION ALL SELECT graph_id, dst, src, src + 10 FROM oe", **ORDERS))
add("t21_instruction_record", lambda s, d: T.instruction_record(X.graph(s, d).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nodes")).withColumn("conversation", F.array(F.lit("ask"), F.lit("answer")))),
    sql("SELECT id, '{\"id\":' || id || ',\"graph\":[' || n || '],\"conversation\":[\"ask\",\"answer\"]}' AS record FROM (SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS n FROM graph GROUP BY 1)", "graph"))

# ---- extension points
add("u01_registry", lambda s, d: U.resolve({"few": {"op": "kfold", "args": {"k": 5, "seed": 3}}}, {"kfold": S.kfold, "all": S.all_train})["few"](X.nodes(s, d).select("id", "label")),
    sql(f"SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY {md5_sql(3, 'id')}, id) - 1) % 5 AS fold FROM nodes", "nodes"))
add("u02_transform_chain", lambda s, d: U.chain("ND0.5,NZ0.25", {"ND": lambda df, p: df.where(md5_bucket("nd", "id", buckets=100) >= p * 100), "NZ": lambda df, p: df.withColumn("size", F.when(md5_bucket("nz", "id", buckets=100) < p * 100, 0).otherwise(F.col("size")))})(X.nodes(s, d).select("id", "size")),
    sql(f"SELECT id, CASE WHEN {bucket_sql('nz', 'id', buckets=100)} < 25 THEN 0 ELSE size END AS size FROM nodes WHERE {bucket_sql('nd', 'id', buckets=100)} >= 50", "nodes"))
add("u03_encoder_hook", lambda s, d: U.encode(X.nodes(s, d).select("id", "name"), lambda t: F.array(F.length(t), F.ascii(t)), "name").select("id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")),
    sql("SELECT id, length(name)::FLOAT AS x0, ascii(name)::FLOAT AS x1 FROM nodes", "nodes"))
add("u04_custom_metric", lambda s, d: r6(U.metric(X.preds(s, d).withColumn("pred", F.col("a")), ["split"], lambda p, y: F.avg(F.abs(p - y))), "value"), sql("SELECT split, round(avg(abs(a - y)), 6) AS value FROM preds GROUP BY 1", "preds"))
add("u05_expand_rows", lambda s, d: U.expand(X.nodes(s, d).select("id", "name"), lambda r: F.split("name", " ")).select("id", "pos", "item"), sql("SELECT id, (generate_subscripts(w, 1) - 1)::INT AS pos, unnest(w) AS item FROM (SELECT id, string_split(name, ' ') AS w FROM nodes)", "nodes"))
add("u04_stateful_metric", lambda s, d: r6(U.metric_with_state(X.scored(s, d).withColumnRenamed("score", "pred"), ["task"], U.HitsAtK(800)), "value"),
    MQ.BOOK.sql["m06_hits_at_k"].replace("SELECT task, round", "SELECT task, value FROM (SELECT task, round", 1).replace("AS hits_800", "AS value") + ")")
add("u05_table_function", lambda s, d: U.expand_table(N.tree_positions(PQ.roots(s, d), X.graph(s, d), [3, 2], -1, 2), U.NodeSequence, ["root"], ["pos"]).select("root", F.array_join("nodes", ",").alias("nodes")), PQ.BOOK.sql["n12_fixed_tree_sequence"])


def probed(s, d):
    """Labels of the vectors as classes; a fifth of the ids are valid rows, a fifth test rows."""
    v, b = X.vectors(s, d), md5_bucket("probe", "id", buckets=5)
    split = F.when(b == 0, "test").when(b == 1, "valid").otherwise("train")
    one = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    return v.select("id", "x", one.alias("y"), split.alias("split"))


add("v19_probe_early_choice", lambda s, d: probe(probed(s, d), 10)[0].select("id", "split", F.array_position("p", F.array_max("p")).cast("int").alias("pred"), F.round(F.array_max("p"), 6).alias("p")))
