"""Queries of sources and sinks (S01 to S14), graph augmentation (G01 to G16), streaming (W01, W02). Files are written
from the driver's tables to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions.ranking import global_rank
from loomgraph.functions.storage import shared_folder, stash, table
from loomgraph.operators import augment as G
from loomgraph.plans import fixtures as X
from loomgraph.plans import log_queries as Q
from loomgraph.plans.fixtures import md5_sql, sql
from loomgraph.plans.path_queries import ORDERS, order_graphs
from loomgraph.sources import files as S
from loomgraph.streaming import usage as W

BOOK = X.Book()
add = BOOK.add


def place(s, name):
    return f"{shared_folder(s)}/loom-{name}-{uuid.uuid4().hex}"


def _csv(s, d, sep, header, codec):
    p = place(s, "csv")
    t = table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "big"\n'), "p_brand").alias("text"))
    t.write.csv(p, header=header, sep=sep, quote='"', escape='"', compression=codec)
    return S.read_csv(s, p, "p_partkey long, text string", sep, header, line_ends=True)


_TXT = "SELECT p_partkey, p_name || ', \"big\"' || chr(10) || p_brand AS text FROM part"
for _n, _a in (("s01_csv_scan", (",", True, "none")), ("s02_tsv_scan", ("\t", False, "none")), ("s03_gz_csv_scan", (",", True, "gzip"))):
    add(_n, lambda s, d, a=_a: _csv(s, d, *a), _TXT)


def _docs_json(s, d):
    """A file for each brand with one document over several lines: its parts as an array of structs."""
    p = place(s, "json")
    doc = F.to_json(F.struct("p_brand", "nodes"), {"pretty": "true"})
    brands = table(s, d, "part").groupBy("p_brand").agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("nodes"))
    brands.select(F.col("p_brand").alias("of"), doc.alias("value")).write.partitionBy("of").option("maxRecordsPerFile", 1).text(p)
    got = S.read_json_documents(s, f"{p}/of=*", "p_brand string, nodes array<struct<p_partkey:long,p_name:string>>")
    return got.select("p_brand", F.inline("nodes"))


add("s04_json_doc_scan", _docs_json, "SELECT p_brand, p_partkey, p_name FROM part")


def _jsonl(s, d):
    p = place(s, "jsonl")
    S.write_jsonl(table(s, d, "events").select("event_id", "event_type", F.when(F.col("value") > 10, F.col("user_id")).alias("model")), p)
    return S.read_jsonl(s, p, "event_id long, event_type string, model long", {"model": -1})


add("s05_s06_jsonl", _jsonl, "SELECT event_id, event_type, CASE WHEN value > 10 THEN user_id ELSE -1 END AS model FROM events")


def _triples(s, d):
    p = place(s, "triples")
    t = X.triples(s, d).select(X.md5_bucket("t", "h", "t", buckets=3).alias("split"), F.concat_ws("\t", "h", "r", "t").alias("value"))
    t.write.partitionBy("split").text(p)
    return S.read_triples(s, p)


add("s07_triple_scan", _triples, sql(f"SELECT {X.bucket_sql('t', 'h', 't', buckets=3)}::VARCHAR AS split, h, r, t FROM triples", "triples"))
add("s08_utf8_clean_scan", lambda s, d: S.clean_utf8(table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit("�"), "p_brand").alias("text")), "text"), "SELECT p_partkey, p_name || p_brand AS text FROM part")


def _dated(s, d):
    p = place(s, "logs")
    e = table(s, d, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("user_id") % 3).cast("int").alias("server"))
    e.write.partitionBy("date", "server").json(p)
    return S.dated_logs(s, p, "event_id long, event_type string", 5)


add("s09_dated_log_glob", _dated, "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS date, (user_id % 3)::INT AS server FROM events WHERE ts::DATE IN (SELECT DISTINCT ts::DATE FROM events ORDER BY 1 DESC LIMIT 5)")
add("s10_split_file_scan", lambda s, d: S.read_split_lists(table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("c")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", "c"))), lambda x: x["c"])).alias("j")), "j"),
    "SELECT n_regionkey AS split, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, n_nationkey AS class FROM nation")


def _artifact(s, d):
    p = place(s, "artifact")
    S.load_or_compute(s, p, lambda: X.nodes(s, d))
    return S.load_or_compute(s, p, lambda: X.nodes(s, d).limit(0))


add("s11_artifact_store", _artifact, sql("SELECT * FROM nodes", "nodes"))
add("s12_type_narrow_sink", lambda s, d: S.narrow_types(table(s, d, "part").select("p_partkey", "p_size")), "SELECT p_partkey, p_size FROM part")


def _parts(s, d):
    p = place(s, "parts")
    S.write_graph_parts(X.nodes(s, d).select("id", "label"), p, [2], 4)
    return s.read.parquet(p).select("id", "label")


add("s13_partitioned_graph_sink", _parts, sql("SELECT id, CASE WHEN label = 2 THEN -1 ELSE label END AS label FROM nodes", "nodes"))
add("s14_sorted_result_sink", lambda s, d: S.write_results(table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.when(F.col("p_size") > 5, F.col("p_name")).alias("answer"), F.element_at(F.split("p_name", " "), 1).alias("truth")).drop("p_name"), place(s, "results")).withColumn("rate", F.round("rate", 6)),
    "SELECT count(*) AS n, 1.0 AS rate FROM part WHERE p_size > 5")


# ---- augmentation: one graph for each order
def gnodes(s, d):
    return order_graphs(s, d)[1]


_NR = f"SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY {md5_sql(1, 'graph_id', 'id')}, id) AS rn, count(*) OVER (PARTITION BY graph_id) AS n FROM ln"
add("g01_drop_nodes", lambda s, d: G.drop_nodes(gnodes(s, d), order_graphs(s, d)[0], 0.3, 1)[1].select("graph_id", "src", "dst"),
    sql("SELECT oe.* FROM oe JOIN k a ON a.graph_id = oe.graph_id AND a.id = src JOIN k b ON b.graph_id = oe.graph_id AND b.id = dst", **ORDERS, k=f"SELECT graph_id, id FROM ({_NR}) WHERE rn > floor(n * 0.3)"))
add("g02_drop_edges", lambda s, d: G.drop_edges(order_graphs(s, d)[0].select("graph_id", "src", "dst"), 0.4, 1),
    sql(f"SELECT graph_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {md5_sql(1, 'graph_id', 'src', 'dst')}, src, dst) AS rn, count(*) OVER (PARTITION BY graph_id) AS n FROM oe) WHERE rn > floor(n * 0.4)", **ORDERS))
_x = lambda s, d: gnodes(s, d).withColumn("x", F.array((F.col("id") * 2).cast("double"), F.lit(1.0)))
add("g04_mask_features", lambda s, d: G.mask_features(_x(s, d), 0.5, 1).select("graph_id", "id", "mask", F.col("x")[0].alias("x0")),
    sql(f"SELECT graph_id, id, rn <= floor(n * 0.5) AS mask, CASE WHEN rn <= floor(n * 0.5) THEN 0 ELSE id * 2 END::DOUBLE AS x0 FROM ({_NR})", **ORDERS))
add("g07_shuffle_features", lambda s, d: G.shuffle_features(_x(s, d), 1).select("graph_id", "id", F.col("x")[0].alias("x0")),
    sql(f"SELECT a.graph_id, a.id, b.id * 2.0 AS x0 FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS p FROM ln) a JOIN ({_NR}) b ON a.graph_id = b.graph_id AND a.p = b.rn", **ORDERS))
add("g11_prompted_graph", lambda s, d: G.prompted_graph(gnodes(s, d), s.range(3).select(F.col("id").alias("class")))[1],
    sql("SELECT graph_id, id AS src, n AS dst, 'f2n' AS type FROM u UNION ALL SELECT graph_id, n, id, 'n2f' FROM u UNION ALL SELECT graph_id, n, n + 1 + c, 'n2c' FROM v, range(3) t(c) UNION ALL SELECT graph_id, n + 1 + c, n, 'c2n' FROM v, range(3) t(c)", **ORDERS, v="SELECT graph_id, count(*) AS n FROM ln GROUP BY 1", u="SELECT * FROM ln JOIN v USING (graph_id)"))
add("g12_graph_masks", lambda s, d: G.prompted_graph(gnodes(s, d), s.range(3).select(F.col("id").alias("class")))[0],
    sql("SELECT graph_id, id, 'feature' AS role FROM ln UNION ALL SELECT graph_id, n, 'task' FROM v UNION ALL SELECT graph_id, n + 1 + c, 'class' FROM v, range(3) t(c)", **ORDERS, v="SELECT graph_id, count(*) AS n FROM ln GROUP BY 1"))
add("g14_supernode", lambda s, d: G.supernode(gnodes(s, d), order_graphs(s, d)[0])[1], sql("SELECT graph_id, src, dst FROM oe UNION ALL SELECT graph_id, id, count(*) OVER (PARTITION BY graph_id) FROM ln", **ORDERS))
add("g16_endpoint_flags", lambda s, d: G.endpoint_flags(_x(s, d).withColumnRenamed("graph_id", "sample_id"), order_graphs(s, d)[0].withColumnRenamed("graph_id", "sample_id")).select("sample_id", "id", F.col("x")[2].alias("head"), F.col("x")[3].alias("tail")),
    sql("SELECT graph_id AS sample_id, id, (id = src)::INT::DOUBLE AS head, (id = dst)::INT::DOUBLE AS tail FROM ln JOIN oe USING (graph_id)", **ORDERS))


# ---- streaming
def _event_files(s, d, rows):
    p = place(s, "stream")
    rows.repartition(4).write.parquet(p)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(p)


def _live_usage(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    # all rows count: the watermark is wider than the log
    out = W.counts_available(W.usage_windows(_event_files(s, d, e), late="400 days"), place(s, "usage"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "kind", "n")


add("w01_live_usage_refresh", _live_usage, "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
add("w02_live_votes", lambda s, d: W.run_available(W.live_votes(_event_files(s, d, X.vote_log(s, d)), late="400 days"), place(s, "votes")), sql("SELECT * FROM battles", "battles"))


def _live_counts(s, d):
    return W.live_counts(_event_files(s, d, Q.usage(s, d)), place(s, "counts"), timezone="America/Bogota")


add("w01_live_recency", lambda s, d: W.live_recency(_live_counts(s, d)).withColumnRenamed("kind", "type"), Q.BOOK.sql["l07_recency_by_type"])
add("w01_live_days", lambda s, d: W.live_days(_live_counts(s, d)).withColumn("day", F.col("day").cast("string")), Q.BOOK.sql["l09_daily_counts"])
add("w01_live_hours", lambda s, d: W.live_hours(_live_counts(s, d), "click"), Q.BOOK.sql["l10_hourly_buckets"])


def _vote_files(s, d, parts=3):
    """The clean votes by time, a file for each of ``parts`` stretches, the older ones first."""
    votes = Q.battles(s, d).withColumn("board", (F.col("vote_id") % 4).cast("string"))
    ranked, p = stash(global_rank(votes, [F.col("tstamp"), F.col("vote_id")], "pos"), "votes"), place(s, "votes")
    n = ranked.count()
    for k in range(parts):
        ranked.where(F.floor((F.col("pos") - 1) * parts / n) == k).drop("pos").coalesce(1).write.mode("append").parquet(p)
    return s.readStream.schema(votes.schema).option("maxFilesPerTrigger", 1).parquet(p)


add("w02_live_ratings", lambda s, d: W.live_ratings(_vote_files(s, d), place(s, "ratings")).withColumn("rating", F.round("rating", 6)), Q.BOOK.sql["l02_elo"])
