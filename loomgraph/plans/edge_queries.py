"""Queries of the edge-table operators (E01 to E23) and of the link heuristics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.ranking import md5_bucket
from loomgraph.functions.storage import table
from loomgraph.operators import edges as E
from loomgraph.operators import heuristics as H
from loomgraph.plans import fixtures as X
from loomgraph.plans.fixtures import sql

BOOK = X.Book()
add = BOOK.add


def _held(s, d):
    return X.pairs(s, d).where(md5_bucket("held", "src", "dst", buckets=10) == 0).select("src", "dst")


HELD = f"SELECT src, dst FROM pairs WHERE {X.bucket_sql('held', 'src', 'dst', buckets=10)} = 0"

add("e01_to_undirected", lambda s, d: E.to_undirected(X.bought(s, d).select("src", "dst", "weight"), "sum", table(s, d, "lineitem").count()),
    sql("SELECT src, dst, sum(weight)::BIGINT AS weight FROM (SELECT src, dst, weight FROM bought UNION ALL SELECT dst, src, weight FROM bought) GROUP BY 1, 2", "bought"))
add("e02_self_loops", lambda s, d: E.add_self_loops(X.bought(s, d), X.nodes(s, d)),
    sql("SELECT src, dst FROM bought WHERE src <> dst UNION ALL SELECT id, id FROM nodes", "bought", "nodes"))
add("e03_coalesce_edges", lambda s, d: E.coalesce_edges(X.bought(s, d)),
    sql("SELECT src, dst, sum(weight)::BIGINT AS weight FROM bought GROUP BY 1, 2", "bought"))
add("e04_adjacency_list", lambda s, d: E.adjacency_list(X.graph(s, d), X.nodes(s, d)).select("id", F.array_join("neighbours", ",").alias("neighbours")),
    sql("SELECT id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS neighbours FROM nodes LEFT JOIN graph ON id = src GROUP BY id", "graph", "nodes"))
add("e05_degree", lambda s, d: E.degree(X.graph(s, d), X.nodes(s, d), cap=8),
    sql("SELECT id, least(count(src), 8)::BIGINT AS degree FROM nodes LEFT JOIN graph ON id = src GROUP BY id", "graph", "nodes"))
add("e06_induced_subgraph", lambda s, d: E.induced_relabelled(X.graph(s, d).select("src", "dst"), X.nodes(s, d).where("label < 3").select("id")),
    sql("SELECT a.r AS src, b.r AS dst FROM graph JOIN m a ON src = a.id JOIN m b ON dst = b.id", "graph", "nodes",
        m="SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM nodes WHERE label < 3"))
add("e07_class_capped_subgraph", lambda s, d: E.class_capped_nodes(X.nodes(s, d), X.graph(s, d), 20),
    sql("SELECT id FROM f UNION SELECT src FROM graph JOIN f ON dst = f.id", "linked",
        f="SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM linked) WHERE rn <= 20"))
add("e08_connected_components", lambda s, d: E.connected_components(X.pairs(s, d)),
    sql("SELECT node, min(other) AS component FROM r GROUP BY node", "graph", recursive=True,
        r="SELECT src AS node, src AS other FROM graph UNION SELECT r.node, g.dst FROM r JOIN graph g ON r.other = g.src"))
add("e08_largest_component", lambda s, d: E.largest_component(X.pairs(s, d)),
    sql("SELECT node AS id FROM c WHERE component = (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)", "graph", recursive=True,
        r="SELECT src AS node, src AS other FROM graph UNION SELECT r.node, g.dst FROM r JOIN graph g ON r.other = g.src",
        c="SELECT node, min(other) AS component FROM r GROUP BY node"))
add("e09_dense_id_map", lambda s, d: E.dense_ids(X.triples(s, d).select(F.explode(F.array("h", "t")).alias("key"))),
    sql("SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT h AS key FROM triples UNION SELECT t FROM triples)", "triples"))


def _entities(s, d):
    return table(s, d, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("c"), "c_custkey").alias("entity"), F.col("c_name").alias("text"))


ENTITIES = "SELECT 'c' || c_custkey AS entity, c_name AS text FROM customer WHERE c_custkey % 3 > 0"
add("e10_unknown_entity_fill", lambda s, d: E.with_unknown(X.triples(s, d), _entities(s, d)),
    sql("SELECT entity, text FROM e UNION ALL SELECT k, 'missing entity' FROM (SELECT h AS k FROM triples UNION SELECT t FROM triples) WHERE k NOT IN (SELECT entity FROM e)", "triples", e=ENTITIES))


def _typed(s, d):
    return X.bought(s, d).select("src", "dst", (F.col("year") - 1990).alias("type"))


add("e11_inverse_relations", lambda s, d: E.with_inverse(_typed(s, d), 20),
    sql("SELECT src, dst, year - 1990 AS type FROM bought UNION ALL SELECT dst, src, year - 1970 FROM bought", "bought"))


def _by_year(s, d):
    """An edge table for each year in which something was bought, numbered in order."""
    all_years = X.once("bought", d, lambda: X.bought(s, d))
    years = sorted(r["year"] for r in all_years.select("year").distinct().collect())
    return {t: all_years.where(F.col("year") == y) for t, y in enumerate(years)}


add("e12_multigraph_flatten", lambda s, d: E.flatten_relations(_by_year(s, d)),
    sql("SELECT src, dst, (dense_rank() OVER (ORDER BY year) - 1)::INT AS type FROM bought", "bought"))
add("e13_bipartite_projection", lambda s, d: X.pairs(s, d), sql("SELECT * FROM pairs", "pairs"))
add("e14_edge_year_filter", lambda s, d: E.year_filtered(X.bought(s, d), 1998),
    sql("SELECT src, dst, sum(weight)::BIGINT AS weight FROM (SELECT src, dst, weight FROM bought WHERE year >= 1998 UNION ALL SELECT dst, src, weight FROM bought WHERE year >= 1998) GROUP BY 1, 2", "bought"))
add("e15_anti_link_removal", lambda s, d: E.without_links(X.graph(s, d), _held(s, d)),
    sql("SELECT src, dst FROM graph WHERE (least(src, dst), greatest(src, dst)) NOT IN (SELECT (src, dst) FROM h)", "graph", h=HELD))


def _samples(s, d):
    """One sample for each held pair: the edges that touch one of its ends."""
    held = _held(s, d).select(F.concat_ws("-", "src", "dst").alias("sample_id"), F.explode(F.array("src", "dst")).alias("src"))
    return held.join(X.graph(s, d).select("src", "dst"), "src").select("sample_id", "src", "dst")


add("e16_target_link_removal", lambda s, d: E.without_target(_samples(s, d), _held(s, d).select(F.concat_ws("-", "src", "dst").alias("sample_id"), "src", "dst")),
    sql("SELECT sample_id, g.src, g.dst FROM s JOIN graph g ON g.src IN (a, b) WHERE NOT (least(g.src, g.dst) = a AND greatest(g.src, g.dst) = b)", "graph",
        h=HELD, s="SELECT src || '-' || dst AS sample_id, src AS a, dst AS b FROM h"))


def _with_split(s, d):
    e = X.pairs(s, d).withColumn("edge_id", F.concat_ws("-", "src", "dst"))
    b = md5_bucket("split", "edge_id", buckets=10)
    return e, e.select("edge_id", F.when(b < 7, "train").when(b < 8, "valid").otherwise("test").alias("split"))


add("e17_train_message_graph", lambda s, d: E.message_edges(*_with_split(s, d), ["train", "valid"]),
    sql(f"SELECT src, dst, weight, edge_id FROM e WHERE {X.bucket_sql('split', 'edge_id', buckets=10)} < 8", "pairs", e="SELECT *, src || '-' || dst AS edge_id FROM pairs"))
add("e18_signed_bidirectional_edges", lambda s, d: E.signed_bidirectional(table(s, d, "orders").select(F.col("o_custkey").alias("src"), F.year("o_orderdate").cast("long").alias("dst"), F.col("o_orderkey").alias("edge_id"))),
    "SELECT o_custkey AS src, year(o_orderdate) AS dst, o_orderkey AS edge_id, 0 AS direction FROM orders UNION ALL SELECT year(o_orderdate), o_custkey, -1 - o_orderkey, 1 FROM orders")
add("e19_offset_count", lambda s, d: E.offsets(table(s, d, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.count(F.lit(1)).alias("n"))),
    "SELECT g, n, coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1)")
add("e19_ragged_index", lambda s, d: E.ragged_index(table(s, d, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.count(F.lit(1)).alias("n"))),
    "SELECT g, unnest(range(n))::INT AS pos FROM (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1)")
for _how, _op in (("union", "UNION"), ("intersection", "INTERSECT"), ("difference", "EXCEPT")):
    add(f"e20_node_set_{_how}", lambda s, d, how=_how: E.set_algebra(X.nodes(s, d).where("label < 3"), X.linked(s, d), how),
        sql(f"SELECT id FROM nodes WHERE label < 3 {_op} SELECT id FROM linked", "linked"))
add("e20_node_set_symmetric", lambda s, d: E.set_algebra(X.nodes(s, d).where("label < 3"), X.linked(s, d), "symmetric"),
    sql("SELECT id FROM nodes WHERE (label < 3) <> (id IN (SELECT id FROM linked))", "linked"))
add("e21_attribute_prune", lambda s, d: E.keep_attributes(table(s, d, "part"), ["p_partkey", "p_brand", "y", "train_mask"]), "SELECT p_partkey, p_brand FROM part")
add("e22_degree_as_feature", lambda s, d: E.degree_as_feature(X.nodes(s, d).select("id", F.array(F.col("size").cast("double")).alias("x")), X.graph(s, d)).select("id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")),
    sql("SELECT id, size::DOUBLE AS x0, count(src)::DOUBLE AS x1 FROM nodes LEFT JOIN graph ON id = src GROUP BY id, size", "nodes", "graph"))
add("e23_consecutive_runs", lambda s, d: E.consecutive_runs(table(s, d, "lineitem"), "l_suppkey", "l_orderkey"),
    "SELECT l_suppkey, min(v) AS first, max(v) AS last, count(*) AS n FROM (SELECT l_suppkey, v, v - row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS run FROM (SELECT DISTINCT l_suppkey, l_orderkey AS v FROM lineitem)) GROUP BY l_suppkey, run")

_WEDGE = "SELECT c.src, c.dst, coalesce(sum(a.weight * b.weight * {w}), 0)::DOUBLE AS score FROM cand c LEFT JOIN graph a ON a.src = c.src LEFT JOIN graph b ON b.src = a.dst AND b.dst = c.dst LEFT JOIN strength m ON m.id = a.dst AND b.dst IS NOT NULL GROUP BY 1, 2"
add("h03_common_neighbours", lambda s, d: H.common_neighbours(H.two_hop_candidates(X.graph(s, d)), X.graph(s, d)), sql(_WEDGE.format(w="1.0"), "cand", "strength"))
add("h04_adamic_adar", lambda s, d: H.adamic_adar(H.two_hop_candidates(X.graph(s, d)), X.graph(s, d)).withColumn("score", F.round("score", 6)),
    sql("SELECT src, dst, round(score, 6) AS score FROM (" + _WEDGE.format(w="CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END") + ")", "cand", "strength"))
add("h05_resource_allocation", lambda s, d: H.resource_allocation(H.two_hop_candidates(X.graph(s, d)), X.graph(s, d)).withColumn("score", F.round("score", 6)),
    sql("SELECT src, dst, round(score, 6) AS score FROM (" + _WEDGE.format(w="1.0 / d") + ")", "cand", "strength"))
