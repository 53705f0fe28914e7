"""Queries of text assembly (T01 to T24), vectors (V01 to V18) and structural counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.storage import table
from loomgraph.operators import edges as E
from loomgraph.operators import paths as P
from loomgraph.operators import reduction as R
from loomgraph.operators import sketches as K
from loomgraph.operators import splits as S
from loomgraph.operators import text as T
from loomgraph.operators import vectors as V
from loomgraph.plans import fixtures as X
from loomgraph.plans.fixtures import md5_sql, sql
from loomgraph.plans.path_queries import BALL, ends, part_pairs

BOOK = X.Book()
add = BOOK.add


def part(s, d):
    return table(s, d, "part")


add("t01_text_template", lambda s, d: part(s, d).select("p_partkey", T.template("part {name} of {brand}, size {size}.", name=F.col("p_name"), brand=F.col("p_brand"), size=F.when(F.col("p_size") > 25, "large").otherwise("small")).alias("text")),
    "SELECT p_partkey, 'part ' || p_name || ' of ' || p_brand || ', size ' || CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END || '.' AS text FROM part")
add("t02_id_text_join", lambda s, d: T.id_text_join(table(s, d, "labels").select("doc_id", "quality"), table(s, d, "documents").select("doc_id", "source", "lang"), "doc_id", "source"),
    "SELECT doc_id, quality, source, lang FROM labels LEFT JOIN documents USING (doc_id) WHERE source IS NOT NULL")
add("t03_three_line_records", lambda s, d: T.block_records(part(s, d).select(F.col("p_partkey").alias("line_no"), F.col("p_name").alias("value")), ["a", "b", "c"]),
    "SELECT p_partkey // 3 AS record, max(p_name) FILTER (p_partkey % 3 = 0) AS a, max(p_name) FILTER (p_partkey % 3 = 1) AS b, max(p_name) FILTER (p_partkey % 3 = 2) AS c FROM part GROUP BY 1")
add("t04_label_text_join", lambda s, d: T.label_texts(table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey"),
    "SELECT n_nationkey, s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
add("t05_pairwise_logic_labels", lambda s, d: T.logic_labels(table(s, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("text"))),
    "SELECT a.n_nationkey * 25 + b.n_nationkey AS position, 'either ' || a.n_name || ' or ' || b.n_name AS text FROM nation a, nation b UNION ALL SELECT a.n_nationkey * 25 + b.n_nationkey + 625, 'not ' || a.n_name || ' and not ' || b.n_name FROM nation a, nation b")
add("t06_entity_text", lambda s, d: part(s, d).select("p_partkey", T.entity_text(F.col("p_name"), F.array("p_brand", "p_type"), F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("string"))).alias("text")),
    "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN 'entity names: ' || p_name || ', entity alternatives: ' || p_brand || ', ' || p_type || '. entity descriptions:' || p_size ELSE 'None' END AS text FROM part")
add("t07_token_join_normalise", lambda s, d: part(s, d).select("p_partkey", T.join_tokens(F.array(F.lit(""), "p_type", "p_name")).alias("text")), "SELECT p_partkey, lower(p_type || ' ' || p_name) AS text FROM part")
add("t08_word_truncate", lambda s, d: table(s, d, "documents").select("doc_id", T.truncate_words(F.col("text"), 12).alias("text")),
    r"SELECT doc_id, array_to_string(regexp_split_to_array(trim(text, ' '), '\s+')[1:12], ' ') AS text FROM documents")


def _dictionary(s, d):
    words, rows = T.text_dictionary(part(s, d).select("p_partkey", F.col("p_name").alias("text")))
    return rows.join(words, "text_id").select("p_partkey", "text_id", "text")


add("t09_text_dictionary", _dictionary, "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS text_id, p_name AS text FROM part")
add("t10_null_text_fill", lambda s, d: part(s, d).select("p_partkey", T.fill_text(F.when(F.col("p_size") > 10, F.col("p_name"))).alias("text")), "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name ELSE '' END AS text FROM part")
add("t11_extra_text_merge", lambda s, d: T.merge_text(part(s, d).select(F.col("p_partkey").alias("id"), "p_name"), table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("text")), "id", "extra"),
    "SELECT p_partkey AS id, p_name, lang AS extra FROM part LEFT JOIN documents ON doc_id = p_partkey")


def _known(s, d):
    return part(s, d).select("p_partkey", F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 3 == 0, "no dict").otherwise(F.concat(F.lit("known: {'"), F.element_at(F.split("p_name", " "), 1), F.lit("': '"), "p_brand", F.lit("'} end"))).alias("know"))


_KN = "SELECT p_partkey, p_name AS text, p_partkey % 3 = 0 AS bad, split_part(p_name, ' ', 1) AS k, p_brand AS v FROM part"
for _how, _e in (("back", "CASE WHEN bad THEN text || 'no dict' ELSE text || ' ' || v || ' ' END"), ("separate", "CASE WHEN bad THEN 'no dict' ELSE ' ' || v || ';' END"), ("inplace", "CASE WHEN bad THEN text || 'no dict' ELSE k || ' (' || v || ') ' || substr(text, length(k) + 1) END")):
    add(f"t12_augment_{_how}", lambda s, d, how=_how: _known(s, d).select("p_partkey", T.augment(F.col("text"), F.col("know"), how).alias("text")), sql(f"SELECT p_partkey, {_e} AS text FROM q", q=_KN))
add("t12_until_brace", lambda s, d: _known(s, d).select("p_partkey", T.until_brace(F.col("know")).alias("text")), sql("SELECT p_partkey, CASE WHEN bad THEN 'no dict' ELSE 'known: {''' || k || ''': ''' || v || '''}' END AS text FROM q", q=_KN))
add("t13_first_seen_names", lambda s, d: T.first_seen_names(part(s, d).select(F.col("p_brand").alias("label"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")), "pos"),
    "SELECT p_brand AS label, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS pos FROM part GROUP BY 1")
add("t14_choice_codes", lambda s, d: T.choice_codes(table(s, d, "nation").select(F.col("n_nationkey").alias("label"))), "SELECT n_nationkey AS label, n_nationkey AS label_id, chr(65 + n_nationkey) AS choice FROM nation")
add("t14_choice_numbers", lambda s, d: T.choice_codes(table(s, d, "supplier").select(F.col("s_suppkey").alias("label"))), "SELECT s_suppkey AS label, r AS label_id, CASE WHEN n <= 26 THEN chr((65 + r)::INT) ELSE '<c' || r || '>' END AS choice FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier)")
add("t15_polarity_label_text", lambda s, d: T.polarity_texts(table(s, d, "documents").select(F.col("doc_id").alias("idx"), F.col("text")), table(s, d, "documents").agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]),
    "SELECT doc_id AS idx, 'The molecule is effective to the following assay. ' || text[1:greatest(length(text) - 41, 0)] AS text FROM documents UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM documents), 'The molecule is not effective to the following assay. ' || text[1:greatest(length(text) - 41, 0)] FROM documents")
add("t16_label_alias_map", lambda s, d: T.alias_labels(table(s, d, "documents").select("doc_id", "lang"), s.createDataFrame([("en", "English"), ("fr", "French")], "raw string, name string"), "lang"),
    "SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS name FROM documents")
add("t16_subject_name", lambda s, d: table(s, d, "documents").select("doc_id", T.subject_name(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("arxiv cs "), "lang")).otherwise(F.col("lang"))).alias("name")),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'arxiv cs.' || upper(lang) ELSE lang END AS name FROM documents")
add("t18_length_histogram", lambda s, d: T.word_histogram(part(s, d).select(F.concat_ws(" ", "p_name", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type"))).alias("t")), "t"),
    "SELECT least(floor((w - lo) * 20 / greatest(hi - lo, 1)), 19)::INT AS bin, count(*) AS n FROM (SELECT w, min(w) OVER () AS lo, max(w) OVER () AS hi FROM (SELECT len(string_split(concat_ws(' ', p_name, p_brand, CASE WHEN p_size > 25 THEN p_type END), ' ')) AS w FROM part)) GROUP BY 1")
add("t19_chat_example", lambda s, d: table(s, d, "documents").select("doc_id", T.chat_example("document", ["en", "fr"], F.col("lang")).alias("t")).select("doc_id", F.col("t")[0]["value"].alias("ask"), F.col("t")[1]["value"].alias("answer")),
    "SELECT doc_id, 'Given a node-centered graph: <graph>, each node represents a document, we need to classify the center node into 2 classes: en, fr, please tell me which class the center node belongs to?' AS ask, lang AS answer FROM documents")
_POOL = "SELECT p_partkey AS id, p_name AS text, p_type AS label FROM part"
add("t20_demo_prompt", lambda s, d: T.demo_prompts(part(s, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), part(s, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("label")), 2, 3),
    sql("SELECT id, block || 'Paper:' || chr(10) || text || chr(10) || 'Label: ' AS prompt FROM p, (SELECT string_agg('Paper:' || chr(10) || text || chr(10) || 'Label: ' || label || chr(10), '' ORDER BY label, rn) AS block FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY " + md5_sql(3, "id") + ", id) AS rn FROM p) WHERE rn <= 2)", p=_POOL))
add("t22_graph_tree_prompt", lambda s, d: T.tree_prompt(table(s, d, "lineitem").join(part(s, d), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("l_returnflag").alias("outer"), F.col("l_linestatus").alias("inner"), F.col("p_name").alias("text")), "l_orderkey"),
    sql("SELECT l_orderkey, '<information>' || string_agg('<' || o || '>' || t || '</' || o || '>', '' ORDER BY o) || '</information>' AS prompt FROM b GROUP BY 1",
        a="SELECT l_orderkey, l_returnflag AS o, l_linestatus AS i, string_agg(p_name, '; ' ORDER BY p_name) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3", b="SELECT l_orderkey, o, string_agg('<' || i || '>' || t || '</' || i || '>', '' ORDER BY i) AS t FROM a GROUP BY 1, 2"))
add("t23_masked_neighbour_text", lambda s, d: T.masked_labels(X.graph(s, d).select(F.col("src").alias("id"), F.col("dst").alias("node")), S.hash_percent_split(X.nodes(s, d).select("id", "label"), 60, 80)).select("id", F.array_join("labels", ",").alias("labels")),
    sql(f"SELECT src AS id, string_agg(CASE WHEN {X.bucket_sql(0, 'id', buckets=100)} < 60 THEN label::VARCHAR ELSE 'NA' END, ',' ORDER BY dst) AS labels FROM graph JOIN nodes ON id = dst GROUP BY 1", "graph", "nodes"))
add("t24_resume_slice", lambda s, d: T.resume(X.nodes(s, d).select("id", "label"), X.linked(s, d).select("id"), 500, 1500), sql("SELECT id, label FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM nodes) WHERE rn > 500 AND rn <= 1500 AND id NOT IN (SELECT id FROM linked)", "linked"))


# ---- vectors
def feats(s, d):
    """Long form of two features of each part."""
    return V.long_form(X.nodes(s, d).select("id", F.array(F.col("size").cast("double"), F.col("label").cast("double")).alias("x")))


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


FE = "SELECT id, 0 AS dim, size::DOUBLE AS val FROM nodes UNION ALL SELECT id, 1, label::DOUBLE FROM nodes"
DEG = "SELECT src, count(*)::DOUBLE AS n FROM graph GROUP BY 1"
SW = "SELECT g.src, g.dst, 1 / sqrt(a.n * b.n) AS w FROM graph g JOIN dg a ON a.src = g.src JOIN dg b ON b.src = g.dst"
add("v01_sym_propagate", lambda s, d: r6(V.hops(feats(s, d), V.sym_weights(X.graph(s, d)), 2), "val"),
    sql("SELECT 0 AS hop, id, dim, val FROM fe UNION ALL SELECT 1, id, dim, round(val, 6) FROM p1 UNION ALL SELECT 2, src, dim, round(sum(w * val), 6) FROM sw JOIN p1 ON id = dst GROUP BY 2, 3", "graph", "nodes", fe=FE, dg=DEG, sw=SW, p1="SELECT src AS id, dim, sum(w * val) AS val FROM sw JOIN fe ON id = dst GROUP BY 1, 2"))
add("v02_row_normalise_adj", lambda s, d: r6(V.row_weights(X.graph(s, d)), "w"), sql("SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS w FROM graph", "graph"))
add("v04_raw_propagate", lambda s, d: V.propagate(feats(s, d), X.graph(s, d).select("src", "dst", F.lit(1.0).alias("w")), 2),
    sql("SELECT g.src AS id, dim, sum(val) AS val FROM graph g JOIN (SELECT src AS id, dim, sum(val) AS val FROM graph JOIN fe ON id = dst GROUP BY 1, 2) ON id = g.dst GROUP BY 1, 2", "graph", "nodes", fe=FE))
add("v05_label_propagate_choice", lambda s, d: V.label_choice(S.hash_percent_split(X.nodes(s, d).select("id", "label"), 60, 80).where("split = 'train'"), X.graph(s, d), 2, X.nodes(s, d)),
    sql("SELECT nodes.id, coalesce(l::VARCHAR, 'NA') AS choice FROM nodes LEFT JOIN (SELECT src, arg_max(label, (c, -label)) AS l FROM (SELECT g.src, t.label, count(*) AS c FROM graph g JOIN graph h ON h.src = g.dst JOIN t ON t.id = h.dst GROUP BY 1, 2) GROUP BY 1) ON src = nodes.id", "graph", "nodes", t=f"SELECT id, label FROM nodes WHERE {X.bucket_sql(0, 'id', buckets=100)} < 60"))
add("v06_rwpe", lambda s, d: r6(V.return_probability(X.graph(s, d), 3), "p"),
    sql("SELECT a.src AS id, 2 AS step, round(sum(a.w * b.w), 6) AS p FROM st a JOIN st b ON b.src = a.dst AND b.dst = a.src GROUP BY 1 UNION ALL SELECT a.src, 3, round(sum(a.w * b.w * c.w), 6) FROM st a JOIN st b ON b.src = a.dst JOIN st c ON c.src = b.dst AND c.dst = a.src GROUP BY 1", "graph", dg=DEG, st="SELECT g.src, g.dst, 1 / n AS w FROM graph g JOIN dg ON dg.src = g.src"))
for _h in ("sum", "avg", "max"):
    add(f"v07_segment_pool_{_h}", lambda s, d, h=_h: r6(V.segment_pool(feats(s, d), X.nodes(s, d).select("id", F.col("kind").alias("g")), h), "val"), sql(f"SELECT kind AS g, dim, round({_h}(val), 6) AS val FROM fe JOIN nodes USING (id) GROUP BY 1, 2", "nodes", fe=FE))
add("v08_tfidf", lambda s, d: r6(V.tfidf(part(s, d).select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))), "weight"),
    "WITH w AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name || ' ' || p_brand), ' ')) AS term FROM part), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2), q AS (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM part)) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS x FROM tf) SELECT id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM q")
def texts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


TERMS = "SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) GROUP BY 1, 2"
add("v08_tfidf_terms", lambda s, d: r6(R.limited_tfidf(texts(s, d)), "weight"),
    sql("SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN k USING (term))", tf=TERMS,
        k="SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 3000"))
add("v08_tfidf_svd", lambda s, d: R.tfidf_svd(texts(s, d))[0])
add("v09_cosine_topk_graph", lambda s, d: r6(V.cosine_top_k(X.vectors(s, d), 5), "sim"),
    sql("SELECT id, other, round(sim, 6) AS sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM (SELECT a.id, b.id AS other, round(list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)), 9) AS sim FROM vectors a JOIN vectors b ON a.id <> b.id) WHERE sim > 0) WHERE rank <= 5", "vectors"))
add("v11_pair_cosine", lambda s, d: r6(V.pair_cosine(part_pairs(s, d), X.nodes(s, d).select("id", F.array(F.col("size").cast("double"), F.lit(3.0)).alias("x"))), "cosine"),
    sql("SELECT src, dst, round((a.size * b.size + 9) / (sqrt(a.size * a.size + 9) * sqrt(b.size * b.size + 9)), 6) AS cosine FROM pairs JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst", "pairs", "nodes"))
LV = "SELECT id, label, unnest(range(len(x)))::INT AS dim, unnest(x) AS val FROM vectors"


def labelled(s, d):
    return V.long_form(X.vectors(s, d)).join(X.vectors(s, d).select("id", "label"), "id")


add("v12_nearest_class", lambda s, d: V.nearest_class(X.vectors(s, d).select("id", "x"), V.wide_form(V.centroids(labelled(s, d)).select(F.col("label").alias("id"), "dim", "val")).withColumnRenamed("id", "label")),
    sql("SELECT v.id, arg_max(c.label, (round(list_dot_product(v.x, c.x), 9), -c.label))::INT AS pred FROM vectors v, (SELECT label, list(m ORDER BY dim) AS x FROM (SELECT label, dim, avg(val) AS m FROM lv GROUP BY 1, 2) GROUP BY 1) c GROUP BY 1", "vectors", lv=LV))
add("v13_class_centroids", lambda s, d: r6(V.centroids(labelled(s, d)), "val"), sql("SELECT label, dim, round(avg(val), 6) AS val, count(*) AS n FROM lv GROUP BY 1, 2", "vectors", lv=LV))
add("v13_distance_to_centre", lambda s, d: r6(V.distance_to_centre(labelled(s, d)), "d2"), sql("SELECT id, label, round(sum((val - m) ** 2), 6) AS d2 FROM (SELECT *, avg(val) OVER (PARTITION BY label, dim) AS m FROM lv) GROUP BY 1, 2", "vectors", lv=LV))
add("v16_standardise", lambda s, d: r6(V.standardise(V.long_form(X.vectors(s, d)), F.col("id") % 5 < 4), "val"),
    sql("SELECT id, dim, round((val - m) / s, 6) AS val FROM lv JOIN (SELECT dim, avg(val) AS m, stddev_pop(val) AS s FROM lv WHERE id % 5 < 4 GROUP BY 1) USING (dim)", "vectors", lv=LV))
add("v16_row_normalise", lambda s, d: r6(V.row_normalise(feats(s, d)), "val"), sql("SELECT id, dim, round(CASE WHEN t <> 0 THEN val / t ELSE 0 END, 6) AS val FROM (SELECT *, sum(val) OVER (PARTITION BY id) AS t FROM fe)", "nodes", fe=FE))
add("v17_entropy_confidence", lambda s, d: r6(V.entropy_confidence(X.vectors(s, d)), "entropy", "spread"),
    sql("SELECT id, round(h, 6) AS entropy, round((n * exp(h) - 1) / (n - 1), 6) AS spread FROM (SELECT id, len(x) AS n, ln(t) - list_sum(list_transform(x, lambda v: v * exp(v))) / t AS h FROM (SELECT *, list_sum(list_transform(x, lambda v: exp(v))) AS t FROM vectors))", "vectors"))
add("v18_balance_weights", lambda s, d: r6(V.balance_weights(table(s, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("token"), F.col("l_linenumber").alias("pos"))), "weight"),
    "SELECT node, token, pos, round(w / sum(w) OVER (PARTITION BY node), 6) AS weight FROM (SELECT l_orderkey AS node, l_suppkey AS token, l_linenumber AS pos, 1.0 / count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS w FROM lineitem)")

# ---- structural counts
CELLS = [(1, 1), (1, 2), (2, 1), (2, 2), (1, 0), (2, 0), (0, 1), (0, 2)]
_at = lambda c, k: f"{c} IS NULL" if k == 0 else f"{c} = {k}"
K07 = "SELECT src, dst, " + ", ".join(f"count(*) FILTER ({_at('ds', i)} AND {_at('dd', j)}) AS n_{i}_{j}" for i, j in CELLS) + " FROM e WHERE node <> src AND node <> dst GROUP BY 1, 2"


def counts(s, d):
    return K.structure_counts(P.end_distances(part_pairs(s, d), X.graph(s, d), 2, False), 2)


add("k07_structure_features", counts, sql(K07, "graph", **ends(False)))
add("k08_degree_normalised", lambda s, d: r6(K.degree_normalised(counts(s, d).select("src", "dst", "n_1_1", "n_2_2"), E.degree(X.graph(s, d), X.nodes(s, d)), ["n_1_1", "n_2_2"]), "n_1_1_norm", "n_2_2_norm"),
    sql("SELECT k.src, k.dst, n_1_1, n_2_2, round(n_1_1 / sqrt(a.n * b.n), 6) AS n_1_1_norm, round(n_2_2 / sqrt(a.n * b.n), 6) AS n_2_2_norm FROM k JOIN dg a ON a.src = k.src JOIN dg b ON b.src = k.dst", "graph", **ends(False), k=K07, dg=DEG))
MH = f"SELECT id, slot::INT AS slot, ('0x' || substr({md5_sql('slot', 'id', 'slot')}, 1, 15))::BIGINT AS h FROM linked, range(32) t(slot)"
MP = "SELECT id, slot, min(h) AS h FROM (SELECT * FROM mh UNION ALL SELECT g.src, slot, h FROM graph g JOIN mh ON mh.id = g.dst) GROUP BY 1, 2"


def hashes(s, d):
    return K.minhash(X.linked(s, d), 32, portable=True)


add("k01_minhash_init", hashes, sql("SELECT * FROM mh", "linked", mh=MH))
# small sets are counted exactly by the sketches
add("k02_hll_init", lambda s, d: K.hll_counts(K.hll_neighbourhoods(X.graph(s, d), X.linked(s, d), 0)).select("id", F.round("n").cast("long").alias("n")), sql("SELECT id, 1 AS n FROM linked", "linked"))
add("k03_minhash_propagate", lambda s, d: K.minhash_propagate(hashes(s, d), X.graph(s, d)), sql("SELECT * FROM mp", "linked", mh=MH, mp=MP))
add("k04_hll_count", lambda s, d: K.hll_counts(K.hll_neighbourhoods(X.graph(s, d), X.linked(s, d), 2)).select("id", "hop", F.round("n").cast("long").alias("n")),
    sql("SELECT root AS id, h::INT AS hop, count(*) AS n FROM ball JOIN range(3) t(h) ON hop <= h GROUP BY 1, 2", "graph", ball=BALL))
add("k05_minhash_jaccard", lambda s, d: K.minhash_jaccard(part_pairs(s, d), K.minhash_propagate(hashes(s, d), X.graph(s, d)), 32),
    sql("SELECT p.src, p.dst, count(*) FILTER (a.h = b.h) / 32 AS jaccard FROM pairs p JOIN mp a ON a.id = p.src JOIN mp b ON b.id = p.dst AND b.slot = a.slot GROUP BY 1, 2", "linked", mh=MH, mp=MP))
add("k06_khop_intersection", lambda s, d: r6(K.intersections(part_pairs(s, d), K.minhash_neighbourhoods(K.minhash(X.linked(s, d), 64), X.graph(s, d), 2), K.hll_neighbourhoods(X.graph(s, d), X.linked(s, d), 2), 64), "n"))


def features(s, d, hops):
    g, n = X.graph(s, d), X.linked(s, d)
    return K.sketch_features(part_pairs(s, d), K.minhash_neighbourhoods(K.minhash(n, 128), g, hops), K.hll_neighbourhoods(g, n, hops, 12), 128, hops)


for _h in (1, 2, 3):
    add(f"k07_sketch_features_{_h}", lambda s, d, h=_h: r6(features(s, d, h), *[f"n_{i}_{j}" for i, j in K.cells(h)]))
