"""Graphs, nodes and samples derived from the driver's tables, each as a DataFrame and as SQL.

``CTE`` holds the SQL of each fixture and the fixtures it needs; :func:`sql` puts them before a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import epoch_micros
from loomgraph.functions.ranking import md5_bucket
from loomgraph.functions.skew import spread
from loomgraph.functions.storage import stash, table
from loomgraph.operators import edges as E

MIN_SHARED = 2


#: Fixtures of the query that is being built, by name and folder; empty between queries.
_stored: dict[tuple[str, str], DataFrame] = {}


def once(name: str, d: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A fixture that a query mentions several times: stored at the first mention, read at the others."""
    if (name, d) not in _stored:
        _stored[name, d] = stash(make(), name)
    return _stored[name, d]


def pairs(s: SparkSession, d: str) -> DataFrame:
    """Parts that were ordered together at least twice: (src < dst, weight)."""
    return once("pairs", d, lambda: E.bipartite_projection(table(s, d, "lineitem"), "l_orderkey", "l_partkey", MIN_SHARED))


def graph(s: SparkSession, d: str) -> DataFrame:
    """The same in both directions."""
    return once("graph", d, lambda: E.to_undirected(pairs(s, d), "sum"))


def nodes(s: SparkSession, d: str) -> DataFrame:
    """(id, label 0..4, kind, name, size) of every part."""
    return table(s, d, "part").select(
        F.col("p_partkey").cast("long").alias("id"),
        (F.col("p_size") % 5).cast("int").alias("label"),
        F.col("p_brand").alias("kind"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
    )


def linked(s: SparkSession, d: str) -> DataFrame:
    """(id, label) of the nodes with an edge."""
    return nodes(s, d).join(graph(s, d).select(F.col("src").alias("id")).distinct(), "id", "left_semi")


def bought(s: SparkSession, d: str) -> DataFrame:
    """Distinct (src customer, dst part, year, weight 1)."""
    o, l = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    n = l.count()
    o, l = spread(o, n, "o_orderkey"), spread(l, n, "l_orderkey")
    rows = o.join(l, o["o_orderkey"] == l["l_orderkey"]).select(
        F.col("o_custkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"), F.year("o_orderdate").alias("year"), F.lit(1).alias("weight")
    )
    return spread(rows, n, "src", "dst").distinct()


def vectors(s: SparkSession, d: str) -> DataFrame:
    """(id, label, x array<double>)."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def scored(s: SparkSession, d: str) -> DataFrame:
    """(id, task, score, y): discounts as scores with many ties, the return flag as label."""
    return table(s, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        (F.col("l_suppkey") % 8).cast("int").alias("task"),
        F.round(F.col("l_discount") * 100).cast("int").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


def triples(s: SparkSession, d: str) -> DataFrame:
    """(h, r, t): customers by order status and parts."""
    o, l = table(s, d, "orders"), table(s, d, "lineitem")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"]).select(
        F.concat(F.lit("c"), "o_custkey").alias("h"), F.col("o_orderstatus").alias("r"), F.concat(F.lit("p"), "l_partkey").alias("t")
    ).distinct()


def preds(s: SparkSession, d: str) -> DataFrame:
    """(id, split, y, a, b): ship years as labels and two models that miss some of them."""
    y, key = F.year("l_shipdate") % 6, F.concat_ws("-", "l_orderkey", "l_linenumber")
    return table(s, d, "lineitem").select(
        key.alias("id"), F.col("l_linestatus").alias("split"), y.alias("y"),
        F.when(F.col("l_linenumber") % 3 == 0, (y + 1) % 6).otherwise(y).alias("a"),
        F.when(F.col("l_partkey") % 4 == 0, F.col("l_suppkey").cast("int") % 6).otherwise(y).alias("b"),
    )


def vote_log(s: SparkSession, d: str) -> DataFrame:
    """Votes between the users (modulo 7) of two consecutive events."""
    e = table(s, d, "events").select("event_id", epoch_micros("ts").alias("us"), "user_id", "event_type", "value")
    a = e.where("event_id % 2 = 0").select((F.col("event_id") / 2).cast("long").alias("vote_id"), *[F.col(c).alias(c + "0") for c in e.columns])
    b = e.where("event_id % 2 = 1").select(((F.col("event_id") - 1) / 2).cast("long").alias("vote_id"), *[F.col(c).alias(c + "1") for c in e.columns])
    v = a.join(b, "vote_id")
    name = lambda i: F.concat(F.when(F.col(f"user_id{i}") % 7 == 5, "bard").otherwise("model"), F.lit("-"), (F.col(f"user_id{i}") % 7).cast("string"))
    hide = (F.col("vote_id") % 3 == 0) | ((F.col("vote_id") % 11 == 0))
    public = [
        F.when(hide, "").when(F.col("vote_id") % 5 == 0, F.concat(F.lit("<h3>Model A: "), name(0), F.lit("</h3>\n"))).otherwise(name(0)),
        F.when(F.col("vote_id") % 3 == 0, "").otherwise(name(1)),
    ]
    kind = (
        F.when(F.col("event_type0") == "error", "chat").when(F.abs(F.col("value0") - F.col("value1")) < 5, F.when(F.col("vote_id") % 2 == 0, "tievote").otherwise("bothbad_vote"))
        .when(F.col("value0") > F.col("value1"), "leftvote").otherwise("rightvote")
    )
    said = F.when(F.col("vote_id") % 13 == 0, "I am ChatGPT").when(F.col("vote_id") % 17 == 0, "LaMDA here").otherwise(F.col("event_type1"))
    turns = F.array(F.array(F.lit("system"), F.lit("x")), F.array(F.lit("user"), F.col("event_type0")), F.array(F.lit("assistant"), said))
    offset = F.when(F.col("vote_id") % 19 == 0, 3).otherwise(1)
    state = lambda i: F.struct(name(i).alias("model_name"), offset.alias("offset"), turns.alias("messages"))
    return v.select("vote_id", kind.alias("type"), (F.col("us0") / 1e6).alias("tstamp"), name(0).alias("model"), F.array(*public).alias("models"), F.array(state(0), state(1)).alias("states"))


class Book:
    """Queries and their SQL, by name."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, query, oracle: str | None = None) -> None:
        def run(s: SparkSession, d: str) -> DataFrame:
            _stored.clear()
            try:
                return query(s, d)
            finally:
                _stored.clear()

        self.queries[name] = run
        if oracle:
            self.sql[name] = oracle


CTE = {
    "preds": ((), "SELECT l_orderkey || '-' || l_linenumber AS id, l_linestatus AS split, year(l_shipdate) % 6 AS y, CASE WHEN l_linenumber % 3 = 0 THEN (year(l_shipdate) % 6 + 1) % 6 ELSE year(l_shipdate) % 6 END AS a, CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 6 ELSE year(l_shipdate) % 6 END AS b FROM lineitem"),
    "votes": ((), """SELECT a.event_id // 2 AS vote_id, CASE WHEN a.event_type = 'error' THEN 'chat' WHEN abs(a.value - b.value) < 5 THEN CASE WHEN a.event_id // 2 % 2 = 0 THEN 'tievote' ELSE 'bothbad_vote' END WHEN a.value > b.value THEN 'leftvote' ELSE 'rightvote' END AS type,
        epoch_us(a.ts) / 1e6 AS tstamp, CASE WHEN a.user_id % 7 = 5 THEN 'bard' ELSE 'model' END || '-' || (a.user_id % 7) AS m0, CASE WHEN b.user_id % 7 = 5 THEN 'bard' ELSE 'model' END || '-' || (b.user_id % 7) AS m1
        FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_id % 2 = 0"""),
    "judged": (("votes",), """SELECT vote_id, tstamp, replace(m0, 'bard', 'palm-2') AS model_a, replace(m1, 'bard', 'palm-2') AS model_b,
        CASE type WHEN 'leftvote' THEN 'model_a' WHEN 'rightvote' THEN 'model_b' WHEN 'tievote' THEN 'tie' ELSE 'tie (bothbad)' END AS win, vote_id % 3 = 0 AS anony, 1 AS rounds,
        CASE WHEN (vote_id % 11 = 0 AND vote_id % 3 <> 0) OR vote_id % 19 = 0 THEN 'invalid' WHEN vote_id % 13 = 0 OR vote_id % 17 = 0 THEN 'leaked' END AS reason FROM votes WHERE type <> 'chat'"""),
    "battles": (("judged",), "SELECT vote_id, tstamp, model_a, model_b, win, anony, rounds FROM judged WHERE reason IS NULL"),
    "bip": ((), "SELECT DISTINCT l_orderkey AS k, l_partkey AS n FROM lineitem"),
    "pairs": (("bip",), f"SELECT a.n AS src, b.n AS dst, count(*) AS weight FROM bip a JOIN bip b ON a.k = b.k AND a.n < b.n GROUP BY 1, 2 HAVING count(*) >= {MIN_SHARED}"),
    "graph": (("pairs",), "SELECT src, dst, sum(weight)::BIGINT AS weight FROM (SELECT * FROM pairs UNION ALL SELECT dst, src, weight FROM pairs) GROUP BY 1, 2"),
    "nodes": ((), "SELECT p_partkey::BIGINT AS id, (p_size % 5)::INT AS label, p_brand AS kind, p_name AS name, p_size AS size FROM part"),
    "linked": (("nodes", "graph"), "SELECT * FROM nodes WHERE id IN (SELECT src FROM graph)"),
    "bought": ((), "SELECT DISTINCT o_custkey::BIGINT AS src, l_partkey::BIGINT AS dst, year(o_orderdate) AS year, 1 AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "vectors": ((), "SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings"),
    "scored": ((), "SELECT l_orderkey || '-' || l_linenumber AS id, (l_suppkey % 8)::INT AS task, round(l_discount * 100)::INT AS score, (l_returnflag = 'R')::INT AS y FROM lineitem"),
    "triples": ((), "SELECT DISTINCT 'c' || o_custkey AS h, o_orderstatus AS r, 'p' || l_partkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "cand": (("graph",), "SELECT DISTINCT a.src, b.dst FROM graph a JOIN graph b ON a.dst = b.src AND a.src < b.dst WHERE NOT EXISTS (SELECT 1 FROM graph g WHERE g.src = a.src AND g.dst = b.dst)"),
    "strength": (("graph",), "SELECT src AS id, sum(weight)::BIGINT AS d FROM graph GROUP BY 1"),
}


def md5_sql(seed, *keys: str) -> str:
    """SQL of ranking.md5_key."""
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || {k}::VARCHAR" for k in keys) + ")"


def bucket_sql(seed, *keys: str, buckets: int) -> str:
    """SQL of ranking.md5_bucket."""
    return f"(('0x' || substr({md5_sql(seed, *keys)}, 1, 8))::BIGINT % {buckets})"


def sql(body: str, *names: str, recursive: bool = False, stored: bool = False, **more: str) -> str:
    """``body`` after the named fixtures and further CTEs, which DuckDB forms once each where they are ``stored``."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        if n not in done:
            for x in CTE[n][0]:
                add(x)
            done[n] = CTE[n][1]

    for n in names:
        add(n)
    done |= more
    head = ", ".join(f"{n} AS {'MATERIALIZED ' if stored else ''}({q})" for n, q in done.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if head else body


__all__ = ["Book", "CTE", "bought", "bucket_sql", "graph", "linked", "md5_bucket", "md5_sql", "nodes", "pairs", "scored", "sql", "triples", "vectors"]
