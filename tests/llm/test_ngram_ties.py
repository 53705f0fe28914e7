"""Pairs at exactly the threshold, of short and long texts."""

import numpy as np
import pytest

from loomgraph.llm import ngram_join


@pytest.mark.parametrize("n", [9, 2_000, 20_000, 50_000, 200_000])
def test_exact_ties_are_links(n):
    # n shared, n / 8 own on each side: n / (n + n / 4) is 0.8; one shared less is none
    n = n // 8 * 8
    own = n // 8
    rng = np.random.default_rng(n)
    base = np.unique(rng.integers(1, 2**63, 2 * n, dtype=np.uint64))[: n + 2 * own]
    rng.shuffle(base)
    a, b = base[: n + own], np.concatenate([base[:n], base[n + own :]])
    both = np.arange(2)
    for left, right in ((both, both), (np.array([0]), np.array([1])), (np.array([1]), np.array([0]))):
        links, low = ngram_join.links_within([np.sort(a), np.sort(b)], np.ones(2), left, right, 0.8)
        assert links.tolist() == [1, 1] and low.tolist() == [0, 0]
        links, _ = ngram_join.links_within([np.sort(a), np.sort(b[1:])], np.ones(2), left, right, 0.8)
        assert links.tolist() == [0, 0]


def test_ties_through_the_join(spark):
    words = [f"w{i}" for i in range(24_004)]
    pairs = []
    for k, n in enumerate((800, 16_000)):  # n shared shingles of five words, then n / 8 more in each text
        text = words[: n + 4]
        more = [[f"{side}{k}_{i}" for i in range(n // 8)] for side in "xy"]
        pairs += [(10 * k, " ".join(text + more[0])), (10 * k + 1, " ".join(text + more[1]))]
    got = {r["id"]: r["n_links"] for r in ngram_join.ngram_join(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == {0: 1, 1: 1, 10: 1, 11: 1}
