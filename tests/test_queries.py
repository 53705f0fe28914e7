"""Registered queries against DuckDB on the smallest tables: one of each kind here, all with ALL_QUERIES=1."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "e01_to_undirected", "e06_induced_subgraph", "e15_anti_link_removal", "e23_consecutive_runs", "h01_khop_pairs", "h04_adamic_adar", "h12_drnl",
    "k07_structure_features", "l01_clean_votes", "l07_recency_by_type", "l10_hourly_buckets", "m02_f1", "m03_roc_auc", "m06_hits_at_k", "m20_ranked_answer_match",
    "n02_batched_negatives", "n12_fixed_tree_sequence", "n15_random_walk", "n20_few_shot_episodes", "p02_per_class_split", "p16_group_greedy_split",
    "p23_quantile_labels", "s01_csv_scan", "s09_dated_log_glob", "t12_augment_inplace", "t22_graph_tree_prompt", "v01_sym_propagate", "v08_tfidf",
    "g11_prompted_graph", "u02_transform_chain", "w01_live_usage_refresh", "w02_live_votes",
]
KNOWN = entry.queries()
NAMES = [n for n in (entry.oracle_sql() if os.environ.get("ALL_QUERIES") else SOME) if n in KNOWN]


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v) + 0.0:.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = KNOWN[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(KNOWN)
