"""Merkle manifests against a plain computation."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root and path of each leaf, by the definition."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        at = [i // 8 for i in at]
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    """(key, leaf, subroot, root, path) of (key, group, leaf) rows."""
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault((group is not None, (group or "").encode()), []).append((key is not None, key or 0, leaf))
    names = sorted(groups)
    subs = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, over = tree([subs[g][0] for g in names])
    return sorted(
        (x[1] if x[0] else -1, x[2], subs[g][0], root, p + above)
        for g, above in zip(names, over) for x, p in zip(sorted(groups[g]), subs[g][1])
    )


def built(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string")
    out = M.proofs(df, "lang", ["doc_id"], "leaf", ["doc_id"]).select("*", M.folded(F.col("leaf"), F.col("path")).alias("again")).collect()
    assert all(r["again"] == r["root"] for r in out)
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in out)


@pytest.mark.parametrize("digits", [1, 4])
def test_trees_of_all_sizes(spark, monkeypatch, digits):
    # with blocks of 8 the trees are built in up to four turns
    monkeypatch.setattr(M, "DIGITS", digits)
    sizes = {"a": 1, "b": 2, None: 8, "é": 9, "": 64, "zz": 65, "z": 520, "hot": 1_300, **{f"g{i}": 1 + i % 3 for i in range(70)}}
    rows = [(i * 7 % 9973, g, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    rows += [(None, "b", sha("x")), (None, "b", sha("x")), (3, "b", sha("same key"))]
    assert built(spark, rows) == plain(rows)


def test_one_row_and_none(spark):
    assert built(spark, [(4, None, sha("only"))]) == [(4, sha("only"), sha("only"), sha("only"), [])]
    assert built(spark, []) == []


def test_fields_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a:1", None, 3, "é", "x", "y"), (2, None, "en", None, "", None, "z")], "doc_id long, source string, lang string, n_chars long, text string, `Leaf` string, `root.h` string")
    leaves = {r["doc_id"]: r["leaf"] for r in M.manifest(docs).collect()}
    assert leaves == {1: sha("1:13:a:1-1:32:é"), 2: sha("1:2-2:en-0:")}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["a", "b", None]), st.sampled_from("pqr").map(sha)), min_size=1, max_size=40))
def test_any_rows(spark, rows):
    assert built(spark, rows) == plain(rows)


def test_tampering_shows(spark):
    got = M.op12(spark, "/root/testdata/sf0.001").collect()
    assert {r["verified"] for r in got} == {True, False} and len({r["root"] for r in got}) == 1
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
