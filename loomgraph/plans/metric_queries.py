"""Queries of the evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.ranking import wide_group_rank
from loomgraph.functions.storage import table
from loomgraph.operators import metrics as M
from loomgraph.plans import fixtures as X
from loomgraph.plans.fixtures import sql

BOOK = X.Book()
add = BOOK.add
LABELS = ["economy", "standard", "promo", "small", "medium", "large"]


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols or df.columns})


add("m01_accuracy", lambda s, d: rounded(M.accuracy(X.preds(s, d).withColumn("pred", F.col("a")), ["split"]), "accuracy"),
    sql("SELECT split, round(avg((a = y)::INT), 6) AS accuracy FROM preds GROUP BY 1", "preds"))
add("m02_f1", lambda s, d: rounded(M.f1(X.preds(s, d).withColumn("pred", F.col("b")))),
    sql("SELECT round(avg(2 * tp / (ny + nb)), 6) AS macro_f1, round(sum(tp) / sum(ny), 6) AS micro_f1 FROM (SELECT l, sum((y = l)::INT) AS ny, sum((b = l)::INT) AS nb, sum((y = l AND b = l)::INT)::DOUBLE AS tp FROM preds, (SELECT DISTINCT y AS l FROM preds UNION SELECT DISTINCT b FROM preds) GROUP BY l)", "preds"))
_AUC = "SELECT task, round(sum(pos * (under + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM g) GROUP BY task"
_AP = "SELECT task, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY task ORDER BY score DESC)) GROUP BY task"
_G = "SELECT task, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM scored GROUP BY 1, 2"
add("m03_roc_auc", lambda s, d: rounded(M.roc_auc(X.scored(s, d), ["task"]), "auc"), sql(_AUC, "scored", g=_G))
add("m04_average_precision", lambda s, d: rounded(M.average_precision(X.scored(s, d), ["task"]), "ap"), sql(_AP, "scored", g=_G))
add("m05_multitask_auc_ap", lambda s, d: M.multitask(X.scored(s, d)).select(F.round("auc", 5).alias("auc"), F.round("ap", 5).alias("ap"), "tasks"),
    sql("SELECT round(avg(auc), 5) AS auc, round(avg(ap), 5) AS ap, count(*) AS tasks FROM u JOIN p USING (task)", "scored", g=_G, u=_AUC, p=_AP))
add("m06_hits_at_k", lambda s, d: rounded(M.hits_at_k(X.scored(s, d), [20, 800, 100000], ["task"]), "hits_20", "hits_800", "hits_100000"),
    sql("SELECT task, " + ", ".join(f"round(CASE WHEN sum(1 - y) < {k} THEN 1 ELSE sum((y = 1 AND score > coalesce(t{k}, -1))::INT)::DOUBLE / sum(y) END, 6) AS hits_{k}" for k in (20, 800, 100000)) + " FROM scored JOIN t USING (task) GROUP BY task", "scored",
        r="SELECT task, score, row_number() OVER (PARTITION BY task ORDER BY score DESC) AS rn FROM scored WHERE y = 0",
        t="SELECT task, max(score) FILTER (rn = 20) AS t20, max(score) FILTER (rn = 800) AS t800, max(score) FILTER (rn = 100000) AS t100000 FROM r GROUP BY task"))


def _one_positive(s, d):
    """Each order's first line is its positive, the others its negatives; lines of the same key are one candidate with
    their largest quantity."""
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("line")).agg(F.max("l_quantity").alias("score"))
    return rows.withColumn("y", (F.col("line") == 1).cast("int"))


_ONE = "SELECT l_orderkey AS q, l_linenumber AS line, max(l_quantity) AS score, (l_linenumber = 1)::INT AS y FROM lineitem GROUP BY l_orderkey, l_linenumber"
add("m07_mrr", lambda s, d: rounded(M.mrr(_one_positive(s, d), "q")),
    sql("SELECT round(avg(1 / ((b + e) / 2 + 1)), 6) AS mrr, count(*)::DOUBLE AS n FROM (SELECT p.q, p.score, coalesce(sum((n.score > p.score)::INT), 0)::DOUBLE AS b, coalesce(sum((n.score >= p.score)::INT), 0)::DOUBLE AS e FROM o p LEFT JOIN o n ON p.q = n.q AND n.y = 0 WHERE p.y = 1 GROUP BY 1, 2)", o=_ONE))
add("m08_task_rank_metrics", lambda s, d: rounded(M.task_ranks(_one_positive(s, d), "q", [F.desc("score"), F.col("line")])),
    sql("SELECT round(avg((r <= 1)::INT), 6) AS hits_1, round(avg((r <= 5)::INT), 6) AS hits_5, round(avg((r <= 10)::INT), 6) AS hits_10, round(avg(1 / r), 6) AS mrr FROM (SELECT min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, line) AS r FROM o) WHERE y = 1 GROUP BY q)", o=_ONE))


def _answers(s, d):
    """(id, text, gt): names of parts, half of them with their type in lower case."""
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), F.lower("p_type"))).otherwise(F.col("p_name")).alias("text"), F.lower("p_type").alias("gt"))


_ANS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || lower(p_type) ELSE p_name END AS text, lower(p_type) AS gt FROM part"
_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_NEAR = f"(SELECT arg_min(i, (levenshtein(text, {_LIST}[i]), i)) FROM range(1, {len(LABELS) + 1}) t(i)) - 1"
_IN = f"(SELECT min(i) FROM range(1, {len(LABELS) + 1}) t(i) WHERE contains(text, {_LIST}[i])) - 1"
add("m09_answer_match", lambda s, d: _answers(s, d).select("id", M.match_label(F.col("text"), LABELS).alias("label")),
    sql(f"SELECT id, coalesce({_IN}, {_NEAR})::INT AS label FROM a", a=_ANS))
add("m09_most_frequent", lambda s, d: _answers(s, d).select("id", M.most_frequent_label(F.col("text"), ["r", "e", "mall"]).alias("label")),
    sql("SELECT id, CASE WHEN greatest(r, e, m) = 0 THEN -1 WHEN r = greatest(r, e, m) THEN 0 WHEN e = greatest(r, e, m) THEN 1 ELSE 2 END AS label FROM (SELECT id, length(text) - length(replace(text, 'r', '')) AS r, length(text) - length(replace(text, 'e', '')) AS e, (length(text) - length(replace(text, 'mall', ''))) / 4 AS m FROM a)", a=_ANS))
add("m10_answer_accuracy", lambda s, d: rounded(M.answer_accuracy(_answers(s, d), LABELS)),
    sql(f"SELECT round(avg((text = gt)::INT), 6) AS strict, round(avg(({_LIST}[n + 1] = gt)::INT), 6) AS nearest FROM (SELECT *, {_NEAR} AS n FROM (SELECT id, trim(lower(text)) AS text, gt FROM a))", a=_ANS))
add("m10_yes_no_accuracy", lambda s, d: rounded(M.yes_no_accuracy(table(s, d, "events").select(F.when(F.col("value") > 20, F.concat(F.lit("Yes, "), "event_type")).when(F.col("value") > 10, F.lit("no")).otherwise(F.col("event_type")).alias("text"), (F.col("user_id") % 2).cast("int").alias("y")))),
    "SELECT round(avg((CASE WHEN value > 20 THEN 1 WHEN value > 10 THEN 0 ELSE -1 END = user_id % 2)::INT), 6) AS accuracy FROM events")
add("m11_model_agreement", lambda s, d: rounded(M.agreement(X.preds(s, d)), "agree"),
    sql("SELECT a = y AS a_ok, b = y AS b_ok, count(*) AS n, min(id) AS first_id, max(id) AS last_id, round(avg((a = b)::INT), 6) AS agree FROM preds GROUP BY 1, 2", "preds"))


def _ranked(s, d):
    """Parts ranked by price within their brand."""
    p = table(s, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), "p_retailprice", (F.col("p_size") % 3).alias("y"), (F.col("p_partkey") % 3).alias("a"), (F.length("p_name") % 3).alias("b"))
    return wide_group_rank(p, ["g"], [F.col("p_retailprice"), F.col("id")]).join(p.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")


add("m12_confidence_bins", lambda s, d: rounded(M.confidence_bins(_ranked(s, d), F.col("n"), 10, ["g"]), "acc_a", "acc_b"),
    "WITH p AS (SELECT p_brand AS g, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n, p_size % 3 AS y, p_partkey % 3 AS a, length(p_name) % 3 AS b FROM part) SELECT g, floor((rn - 1) / ceil(n / 10))::BIGINT AS bin, round(avg((a = y)::INT), 6) AS acc_a, round(avg((b = y)::INT), 6) AS acc_b FROM p GROUP BY 1, 2")


def _choices(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("pred"), F.col("l_linestatus").alias("y"))


add("m13_choice_stats", lambda s, d: rounded(M.choice_stats(_choices(s, d).withColumn("y", F.when(F.col("y") == "F", "A").otherwise("N")), ["A", "N"])),
    "SELECT round(v, 6) AS valid_rate, round(c, 6) AS accuracy, round(c / v, 6) AS accuracy_in_valid FROM (SELECT avg((l_returnflag IN ('A', 'N'))::INT) AS v, avg((l_returnflag = CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END)::INT) AS c FROM lineitem)")
add("m13_choice_distribution", lambda s, d: rounded(M.choice_distribution(_choices(s, d), ["A", "N"]), "share"),
    "SELECT l_returnflag AS pred, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1")
add("m14_run_summary", lambda s, d: rounded(M.run_summary(table(s, d, "supplier").select((F.col("s_suppkey") % 7).alias("config"), F.col("s_acctbal").alias("val"), F.col("s_nationkey").cast("double").alias("test"))), "val_mean", "val_std", "test_mean", "test_std"),
    "WITH g AS (SELECT s_suppkey % 7 AS config, avg(s_acctbal) AS vm, stddev_pop(s_acctbal) AS vs, avg(s_nationkey) AS tm, stddev_pop(s_nationkey) AS ts FROM supplier GROUP BY 1) SELECT config, round(vm, 6) AS val_mean, round(vs, 6) AS val_std, round(tm, 6) AS test_mean, round(ts, 6) AS test_std, row_number() OVER (ORDER BY vm DESC, config) = 1 AS best FROM g")
add("m14_best_epoch", lambda s, d: M.best_epoch(table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.round("o_totalprice").alias("val"), F.col("o_orderkey").alias("test"))),
    "SELECT o_custkey AS run, arg_max(o_orderkey, (round(o_totalprice), -o_orderkey)) AS test, max(round(o_totalprice)) AS val FROM orders GROUP BY 1")
add("m15_anova", lambda s, d: M.anova(table(s, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("v"))).withColumn("f", F.round("f", 6)),
    "WITH g AS (SELECT count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS s FROM customer GROUP BY c_mktsegment), t AS (SELECT avg(c_acctbal) AS mm FROM customer) SELECT round((sum(n * (m - mm) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 6) AS f, count(*) - 1 AS df_between, (sum(n) - count(*))::BIGINT AS df_within FROM g, t")


def _two(s, d):
    return table(s, d, "customer").select((F.col("c_nationkey") % 6).alias("a"), F.col("c_mktsegment").alias("b"))


_CT = "SELECT c_nationkey % 6 AS a, c_mktsegment AS b, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY c_nationkey % 6)::DOUBLE AS na, sum(count(*)) OVER (PARTITION BY c_mktsegment)::DOUBLE AS nb, sum(count(*)) OVER ()::DOUBLE AS t FROM customer GROUP BY 1, 2"
add("m16_nmi", lambda s, d: rounded(M.nmi(_two(s, d))), sql("SELECT round(2 * sum(n / t * ln(n * t / (na * nb))) / (-sum(n / t * ln(na / t)) - sum(n / t * ln(nb / t))), 6) AS nmi FROM c", c=_CT))
add("m17_community_f1", lambda s, d: rounded(M.community_f1(_two(s, d))),
    sql("SELECT round((fa + fb) / 2, 6) AS f, round(fa, 6) AS f_a, round(fb, 6) AS f_b FROM (SELECT avg(f) AS fa FROM (SELECT max(2 * n / (na + nb)) AS f FROM c GROUP BY a)), (SELECT avg(f) AS fb FROM (SELECT max(2 * n / (na + nb)) AS f FROM c GROUP BY b))", c=_CT))
add("m18_minmax_scale", lambda s, d: rounded(M.minmax_scale(table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal"), "scaled"),
    "SELECT s_suppkey, s_nationkey, s_acctbal, round(CASE WHEN max(s_acctbal) OVER w > min(s_acctbal) OVER w THEN (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) ELSE 0 END, 6) AS scaled FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
add("m19_mae", lambda s, d: rounded(M.mae(X.preds(s, d).withColumn("pred", F.col("b")))), sql("SELECT round(avg(abs(b - y)), 6) AS mae FROM preds", "preds"))


def _lists(s, d):
    t = F.lower("p_type")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Answer: ['"), t, F.lit("', 'x']."))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("['"), F.col("p_name"), F.lit("']"))).otherwise(F.concat("p_name", F.lit(" is "), "p_type")).alias("text"))


add("m20_ranked_answer_match", lambda s, d: M.ranked_answer(_lists(s, d), LABELS),
    sql(f"SELECT id, (CASE WHEN k = 0 THEN (SELECT i FROM range(1, 7) r(i) WHERE {_LIST}[i] = t) - 1 WHEN k = 1 THEN {_NEAR} ELSE {_IN} END)::INT AS label, k <> 0 AS miss FROM (SELECT p_partkey AS id, p_partkey % 3 AS k, lower(p_type) AS t, CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE p_name || ' is ' || lower(p_type) END AS text FROM part)"))
