"""Spelling variants against a comparison of all pairs."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def plain(rows, least_chars=6, least_n=5, one_in=199):
    n = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least_n}
    form, count = {}, {}
    for w in n:
        other = [v for v in n if near(w, v)]
        count[w] = len(other)
        best = min(other, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n)


def built(spark, rows, **limits):
    return sorted(tuple(r) for r in S.variants(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect())


def test_chains_ties_and_repeats(spark):
    words = {"colour": 1000, "color": 150, "colours": 150, "colou": 30, "colo": 6, "colxu": 6, "aaaa": 40, "aaaaa": 8, "aaa": 8, "àaaa": 7, "baaa": 7, "ab": 300, "ba": 300, "bb": 3, "Ünter": 20, "ünter": 2}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())] + [(None, None), (7, ""), (7, "AAAA AAAA"), (7, "AAAA AAAA")]
    args = dict(least_chars=2, least_n=1, one_in=10**12)
    got = built(spark, rows, **args)
    assert got == plain(rows, **args)
    assert {w: r for w, _, r, *_ in got}["colo"] == "colour"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 99)), st.lists(st.text("abÀÿ", min_size=1, max_size=5), max_size=30).map(" ".join)), min_size=1, max_size=8))
def test_any_texts(spark, rows):
    args = dict(least_chars=1, least_n=1, one_in=3)
    assert built(spark, rows, **args) == plain(rows, **args)


def test_empty_and_clashing_names(spark):
    assert built(spark, []) == []
    docs = spark.createDataFrame([(1, "lettering " * 50 + "leterings " * 5 + "letterings " * 9, 1, "x")], "doc_id long, text string, `Word` int, `n.near` string")
    assert sorted(tuple(r) for r in S.variants(docs).collect()) == plain([(1, "lettering " * 50 + "leterings " * 5 + "letterings " * 9)])


@pytest.mark.parametrize("word,m", [("ab", 5), ("aaa", 7)])
def test_rotations(spark, word, m):
    got = [tuple(r) for r in S.rotations(spark.createDataFrame([(word, 1)], "word string, n long")).collect()]
    assert len(got) == m and {p + c for p, c, _, _ in got} == {(word + "$")[i:] + (word + "$")[:i] for i in range(len(word) + 1)}
