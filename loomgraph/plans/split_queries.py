"""Queries of the splits and label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.storage import table
from loomgraph.operators import edges as E
from loomgraph.operators import splits as P
from loomgraph.plans import fixtures as X
from loomgraph.plans.fixtures import bucket_sql, md5_sql, sql

BOOK = X.Book()
add = BOOK.add


def rows(s, d):
    return X.nodes(s, d).select("id", "label")


def molecules(s, d):
    """(id, y): quality and toxicity of documents, null where not labelled."""
    doc, lab = table(s, d, "documents").select(F.col("doc_id").alias("id")), table(s, d, "labels").withColumnRenamed("doc_id", "id")
    return doc.join(lab, "id", "left").select("id", F.array("quality", "toxic").alias("y"))


MOL = "SELECT d.doc_id AS id, quality AS y0, toxic AS y1 FROM documents d LEFT JOIN labels l USING (doc_id)"
RANK = f"SELECT id, label, row_number() OVER (ORDER BY {md5_sql(7, 'id')}, id) AS rn, count(*) OVER () AS n FROM nodes"
CUT = "CASE WHEN rn <= floor(n * {a}) THEN 'train' WHEN rn <= floor(n * {a}) + floor(n * {b}) THEN 'valid' ELSE 'test' END AS split"


def own(seed, group="label", key="id"):
    return f"row_number() OVER (PARTITION BY {group} ORDER BY {md5_sql(seed, key)}, {key})"


add("p01_ratio_split", lambda s, d: P.ratio_split(rows(s, d), (0.6, 0.2, 0.2), 7), sql("SELECT id, label, " + CUT.format(a=0.6, b=0.2) + " FROM r", "nodes", r=RANK))
add("p02_per_class_split", lambda s, d: P.per_class_split(rows(s, d), 20, 100, 200, 7),
    sql("SELECT id, label, 'train' AS split FROM o WHERE own <= 20 UNION ALL SELECT id, label, CASE WHEN rn <= 100 THEN 'valid' ELSE 'test' END FROM (SELECT *, row_number() OVER (ORDER BY h, id) AS rn FROM o WHERE own > 20) WHERE rn <= 300", "nodes",
        o=f"SELECT id, label, {md5_sql(7, 'id')} AS h, {own(7)} AS own FROM nodes"))
add("p03_stratified_kfold", lambda s, d: P.fold_splits(P.kfold(rows(s, d), 5, 3), 5),
    sql("SELECT id, label, fold, round, CASE WHEN fold = round THEN 'test' WHEN fold = (round + 1) % 5 THEN 'valid' ELSE 'train' END AS split FROM f, range(5) t(round)", "nodes", f=f"SELECT id, label, ({own(3)} - 1) % 5 AS fold FROM nodes"))
add("p04_class_holdout_split", lambda s, d: P.class_holdout(rows(s, d), s.range(5).select(F.col("id").cast("int").alias("label"), F.when(F.col("id") < 3, "train").when(F.col("id") < 4, "valid").otherwise("test").alias("split"))),
    sql("SELECT id, label, CASE WHEN label < 3 THEN 'train' WHEN label < 4 THEN 'valid' ELSE 'test' END AS split FROM nodes", "nodes"))
add("p05_class_index", lambda s, d: P.class_index(X.nodes(s, d).select("id", F.col("kind").alias("label"))).select("label", F.array_join("ids", ",").alias("ids")),
    sql("SELECT kind AS label, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM nodes GROUP BY 1", "nodes"))
_PR = f"SELECT src, dst, row_number() OVER (ORDER BY {md5_sql(1, 'k')}, k) AS rn, count(*) OVER () AS n FROM (SELECT src, dst, src || '-' || dst AS k FROM pairs)"
add("p06_edge_split", lambda s, d: P.ratio_split(X.pairs(s, d).select("src", "dst", F.concat_ws("-", "src", "dst").alias("k")), (0.7, 0.1, 0.2), 1, "k").drop("k"),
    sql("SELECT src, dst, " + CUT.format(a=0.7, b=0.1) + " FROM r", "pairs", r=_PR))
add("p07_link_split", lambda s, d: P.link_split(X.pairs(s, d).select("src", "dst"), (0.8, 0.1, 0.1), 1),
    sql("SELECT split AS stage, 'supervision' AS role, src, dst FROM t UNION ALL SELECT stage, 'message', src, dst FROM t, (VALUES ('train'), ('valid'), ('test')) v(stage) WHERE split = 'train' UNION ALL SELECT 'test', 'message', src, dst FROM t WHERE split = 'valid'", "pairs",
        r=_PR, t="SELECT src, dst, " + CUT.format(a=0.8, b=0.1) + " FROM r"))
add("p08_time_split", lambda s, d: P.time_split(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")), (0.6, 0.2)),
    "SELECT id, year, " + CUT.format(a=0.6, b=0.2) + " FROM (SELECT o_orderkey AS id, year(o_orderdate) AS year, row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)")
add("p09_nested_subsample", lambda s, d: P.nested_subsample(rows(s, d), (0.5, 0.25, 0.25), {"train": 0.03, "valid": 0.25, "test": 0.5}, 7),
    sql(f"SELECT id, label, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {md5_sql('7-keep', 'id')}, id) AS k, count(*) OVER (PARTITION BY split) AS m FROM t) WHERE k <= floor(m * CASE split WHEN 'train' THEN 0.03 WHEN 'valid' THEN 0.25 ELSE 0.5 END)", "nodes",
        r=RANK, t="SELECT id, label, " + CUT.format(a=0.5, b=0.25) + " FROM r"))
add("p10_mask_to_split", lambda s, d: P.mask_to_split(rows(s, d).select("id", *[F.array(*[F.col("id") % m == k for k in (0, 1)]).alias(n) for n, m in (("a", 3), ("b", 5))]), {"train": "a", "valid": "b"}),
    sql("SELECT k::INT AS seed, id, 'train' AS split FROM nodes, range(2) t(k) WHERE id % 3 = k UNION ALL SELECT k::INT, id, 'valid' FROM nodes, range(2) t(k) WHERE id % 5 = k", "nodes"))
add("p10_split_to_mask", lambda s, d: P.split_to_mask(P.hash_percent_split(rows(s, d), 60, 80), rows(s, d), "valid"), sql(f"SELECT id, {bucket_sql(0, 'id', buckets=100)} BETWEEN 60 AND 79 AS mask FROM nodes", "nodes"))
add("p11_ordered_split_ids", lambda s, d: P.ordered_split_ids({"train": rows(s, d).where("label < 3"), "valid": rows(s, d).where("label = 3"), "test": rows(s, d).where("label = 4")}, [F.col("id")]),
    sql("SELECT id, label, row_number() OVER (ORDER BY greatest(label, 2), id) - 1 AS row_id, CASE WHEN label < 3 THEN 'train' WHEN label = 3 THEN 'valid' ELSE 'test' END AS split FROM nodes", "nodes"))
_HASH = f"SELECT id, label, CASE WHEN {bucket_sql(0, 'id', buckets=100)} < 60 THEN 'train' WHEN {bucket_sql(0, 'id', buckets=100)} < 80 THEN 'valid' ELSE 'test' END AS split FROM nodes"
add("p12_low_rate_split", lambda s, d: P.low_rate_split(P.hash_percent_split(rows(s, d), 60, 80), 3, {"valid": 50, "test": 100}, 5),
    sql(f"SELECT id, label, split FROM (SELECT *, {own(5)} AS rn FROM h WHERE split = 'train') WHERE rn <= 3 UNION ALL SELECT id, label, split FROM (SELECT *, {own(5, 'split')} AS rn FROM h WHERE split <> 'train') WHERE rn <= CASE split WHEN 'valid' THEN 50 ELSE 100 END", "nodes", h=_HASH))
add("p13_polarity_class_index", lambda s, d: P.polarity_classes(molecules(s, d)), sql("SELECT (2 * (y0 = 1)::INT)::INT AS class, id FROM m WHERE y0 IS NOT NULL UNION ALL SELECT (1 + 2 * (y1 = 1)::INT)::INT, id FROM m WHERE y1 IS NOT NULL", m=MOL))
add("p14_stratified_subset", lambda s, d: P.stratified_subset(rows(s, d), {"train": 10, "valid": 5, "test": 20}, 2),
    sql(f"SELECT id, label, CASE WHEN rn <= 10 THEN 'train' WHEN rn <= 15 THEN 'valid' ELSE 'test' END AS split FROM (SELECT id, label, {own(2)} AS rn FROM nodes) WHERE rn <= 35", "nodes"))
add("p15_hub_few_shot_split", lambda s, d: P.hub_few_shot(rows(s, d).join(E.degree(X.graph(s, d), X.nodes(s, d)), "id"), 5, 2).drop("degree"),
    sql(f"SELECT id, label, 'train' AS split FROM h WHERE hub <= 5 UNION ALL SELECT id, label, CASE WHEN {own(2)} % 2 = 1 THEN 'valid' ELSE 'test' END FROM h WHERE hub > 5", "nodes", "graph",
        g="SELECT id, label, count(src) AS degree FROM nodes LEFT JOIN graph ON id = src GROUP BY 1, 2", h="SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY degree DESC, id) AS hub FROM g"))


def grouped(s, d):
    return X.nodes(s, d).select("id", F.col("name").alias("g0"))


add("p16_group_greedy_split", lambda s, d: P.group_greedy_split(grouped(s, d), "g0", (0.8, 0.1)),
    sql("SELECT id, name AS g0, split FROM nodes JOIN f ON name = g", "nodes", recursive=True,
        z="SELECT name AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, name) AS k, sum(count(*)) OVER () AS t FROM nodes GROUP BY 1",
        f="""SELECT g, k, t, CASE WHEN n <= t * 0.8 THEN 'train' WHEN n <= t * (0.8 + 0.1) THEN 'valid' ELSE 'test' END AS split, (CASE WHEN n <= t * 0.8 THEN n ELSE 0 END)::DOUBLE AS a, (CASE WHEN n > t * 0.8 AND n <= t * (0.8 + 0.1) THEN n ELSE 0 END)::DOUBLE AS b FROM z WHERE k = 1
        UNION ALL SELECT z.g, z.k, z.t, CASE WHEN a + n <= z.t * 0.8 THEN 'train' WHEN a + b + n <= z.t * (0.8 + 0.1) THEN 'valid' ELSE 'test' END, a + CASE WHEN a + n <= z.t * 0.8 THEN n ELSE 0 END, b + CASE WHEN a + n > z.t * 0.8 AND a + b + n <= z.t * (0.8 + 0.1) THEN n ELSE 0 END FROM f JOIN z ON z.k = f.k + 1"""))
add("p17_group_random_split", lambda s, d: P.group_random_split(grouped(s, d), "g0", (0.8, 0.1, 0.1), 4),
    sql("SELECT id, name AS g0, split FROM nodes JOIN f ON name = g", "nodes", recursive=True,
        z=f"SELECT name AS g, count(*) AS n, row_number() OVER (ORDER BY {md5_sql(4, 'name')}, name) AS k, floor(sum(count(*)) OVER () * 0.1) AS t FROM nodes GROUP BY 1",
        f="""SELECT g, k, CASE WHEN n <= t THEN 'valid' ELSE 'train' END AS split, 0::DOUBLE AS a, (CASE WHEN n <= t THEN n ELSE 0 END)::DOUBLE AS b FROM z WHERE k = 1
        UNION ALL SELECT z.g, z.k, CASE WHEN b + n <= t THEN 'valid' WHEN a + n <= t THEN 'test' ELSE 'train' END, a + CASE WHEN b + n > t AND a + n <= t THEN n ELSE 0 END, b + CASE WHEN b + n <= t THEN n ELSE 0 END FROM f JOIN z ON z.k = f.k + 1"""))
add("p18_nonnull_random_split", lambda s, d: P.nonnull_random_split(molecules(s, d), 1, (0.8, 0.1, 0.1), seed=7).select("id", "split"),
    sql("SELECT id, " + CUT.format(a=0.8, b=0.1) + " FROM r", m=MOL, r=f"SELECT id, row_number() OVER (ORDER BY {md5_sql(7, 'id')}, id) AS rn, count(*) OVER () AS n FROM m WHERE y1 IS NOT NULL"))
add("p19_hash_percent_split", lambda s, d: P.hash_percent_split(rows(s, d), 60, 80), sql("SELECT * FROM h", "nodes", h=_HASH))
add("p20_class_shuffle_split", lambda s, d: P.class_shuffle_split(X.nodes(s, d).select(F.col("kind").alias("label")), 3),
    sql(f"SELECT label, CASE WHEN rn <= floor(CASE WHEN n <= 20 THEN n / 3 ELSE n * 0.6 END) THEN 'train' WHEN rn <= floor(CASE WHEN n <= 20 THEN n * 2 / 3 ELSE n * 0.8 END) THEN 'valid' ELSE 'test' END AS split FROM (SELECT label, count(*) OVER () AS n, row_number() OVER (ORDER BY {md5_sql(3, 'label')}, label) AS rn FROM (SELECT DISTINCT kind AS label FROM nodes))", "nodes"))
add("p21_index_split_701020", lambda s, d: P.ratio_split(rows(s, d), (0.7, 0.1, 0.2), 7), sql("SELECT id, label, " + CUT.format(a=0.7, b=0.1) + " FROM r", "nodes", r=RANK))
add("p22_negated_label_code", lambda s, d: P.negated_labels(P.hash_percent_split(rows(s, d), 60, 80), "train", 50),
    sql("SELECT id, label, split, CASE WHEN split = 'train' AND rn <= 50 THEN label ELSE -1 - label END AS code FROM (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY id) AS rn FROM h)", "nodes", h=_HASH))
add("p23_quantile_labels", lambda s, d: P.quantile_labels(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 5),
    "SELECT p_partkey, p_retailprice, len(list_filter(e, lambda x: x <= p_retailprice))::INT AS label FROM part, (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM part)")
add("p24_within_node_tail_split", lambda s, d: P.within_node_tail(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey")], 0.7),
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n >= 2")
add("p25_sample_rows", lambda s, d: P.sample_rows(rows(s, d), 0.1, 7), sql("SELECT id, label FROM r WHERE rn <= floor(n * 0.1)", "nodes", r=RANK))
add("p26_rare_class_drop", lambda s, d: P.drop_rare_classes(X.nodes(s, d).select("id", F.col("kind").alias("label")), 40), sql("SELECT id, kind AS label FROM nodes WHERE kind IN (SELECT kind FROM nodes GROUP BY 1 HAVING count(*) >= 80)", "nodes"))


def _tasks(s, d):
    """Line numbers as tasks of their order: (item, task, value), and all tasks there are."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("task"), F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "N", "No").alias("value"))
    return P.label_matrix(lines, sorted(r["task"] for r in lines.select("task").distinct().collect()))


# orders have up to seven lines
add("p27_multitask_label_matrix", _tasks,
    "SELECT l_orderkey AS item, " + ", ".join(f"max(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 END) FILTER (l_linenumber = {k}) AS \"{k}\"" for k in range(1, 8)) + " FROM lineitem GROUP BY 1")
add("p28_label_recode", lambda s, d: P.recode(molecules(s, d)).select("id", F.col("y")[0].alias("a"), F.col("y")[1].alias("b")), sql("SELECT id, CASE WHEN y0 IS NULL THEN 0 WHEN y0 = 0 THEN -1 ELSE y0 END AS a, CASE WHEN y1 IS NULL THEN 0 WHEN y1 = 0 THEN -1 ELSE y1 END AS b FROM m", m=MOL))
add("p29_label_pad_union", lambda s, d: P.pad_union(molecules(s, d).where("id % 2 = 0"), 2, molecules(s, d).where("id % 2 = 1").select("id", F.slice("y", 1, 1).alias("y")), 1).select("id", *[F.col("y")[i].alias(f"y{i}") for i in range(3)]),
    sql("SELECT id, CASE WHEN id % 2 = 0 THEN y0 ELSE 0 END AS y0, CASE WHEN id % 2 = 0 THEN y1 ELSE 0 END AS y1, CASE WHEN id % 2 = 0 THEN 0 ELSE y0 END AS y2 FROM m", m=MOL))
add("p30_task_polarity_counts", lambda s, d: P.polarity_counts(molecules(s, d)), sql("SELECT t::INT AS task, count(*) FILTER (v = 1) AS positive, count(*) FILTER (v = 0) AS negative FROM (SELECT 0 AS t, y0 AS v FROM m UNION ALL SELECT 1, y1 FROM m) GROUP BY 1", m=MOL))
add("p31_label_encoders", lambda s, d: molecules(s, d).withColumn("k", (F.col("id") % 3).cast("int")).select("id", F.array_join(P.one_hot("k", 3), "").alias("hot"), F.array_join(P.reversed_binary("k"), "").alias("rev"), F.array_join(P.known_labels("y"), "").alias("known"), F.array_join(P.label_and_complement("y"), "").alias("both")),
    sql("SELECT id, ['100', '010', '001'][(id % 3 + 1)::INT] AS hot, ['01', '10', '00'][(id % 3 + 1)::INT] AS rev, concat(y0, y1) AS known, concat(y0, y1, 1 - y0, 1 - y1) AS both FROM m", m=MOL))
add("p32_logic_label", lambda s, d: P.logic_labels(rows(s, d), 5, 3, 1),
    sql("SELECT id, draw, a, b, (label IN (a, b))::INT AS either, (label NOT IN (a, b))::INT AS neither FROM q", "nodes", q=f"SELECT id, label, draw::INT AS draw, {bucket_sql('1-a', 'id', 'draw', buckets=5)} AS a, {bucket_sql('1-b', 'id', 'draw', buckets=5)} AS b FROM nodes, range(3) t(draw)"))
add("p33_length_balanced_batches", lambda s, d: P.length_batches(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length")), 64, 4, 2),
    f"SELECT id, length, batch, CASE WHEN p < 4 THEN p ELSE 7 - p END AS shard FROM (SELECT *, (row_number() OVER (PARTITION BY batch ORDER BY length DESC, id) - 1) % 8 AS p FROM (SELECT doc_id AS id, n_chars AS length, (row_number() OVER (ORDER BY {md5_sql(2, 'doc_id')}, doc_id) - 1) // 64 AS batch FROM documents))")
