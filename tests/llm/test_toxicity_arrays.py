"""The array forms of cleaning and hashing words against their plain forms."""

import random

import numpy as np
import pytest

from loomgraph.llm import langid, toxicity

ODD = [None, "", " ", "12 ?!", "́", "á", "ΑΣ", "ΑΣΑ", "Σ", "İI", "ab abc abcd abcde abcdef", "ßabcé ñandú", "नमस्ते x", "\U00010400b a"]
ODD += ["x" * n for n in (63, 64, 65, 5_000)] + ["é" * 32 + " " + "é" * 33 + " z"]


def odd_texts():
    rng = random.Random(3)
    pick = lambda: chr(rng.choice([rng.randrange(0x80), rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
    return ODD + ["".join(pick() for _ in range(rng.randrange(60))) for _ in range(300)]


def test_cleaning_and_counts():
    texts = odd_texts()
    clean = langid.all_letters(texts)
    assert clean == [langid.letters(t) for t in texts] and langid.all_letters([]) == []
    for some in (clean, ["", " a ", "a", "ab", "", "b"], ["a"], [""], []):
        got = langid.clean_counts(some)
        assert got.shape == (len(some), langid.DIMS)
        alone = [langid.clean_counts([c])[0] for c in some]  # no n-gram runs over two texts
        assert all((a == b).all() for a, b in zip(got, alone))
        assert got.sum() == sum(max(len(c) - n, 0) for c in some for n in range(3))


def plain_logit(net, text):
    x = [net.emb[list(toxicity.word_rows(w))].sum(axis=0) for w in text.split()] + [np.zeros(toxicity.WIDTH, np.float32)] * toxicity.PADS
    z = []
    for n, w, b in zip(toxicity.SPANS, net.filters, net.bias):
        z.append(np.max([np.concatenate(x[k : k + n]) @ w for k in range(len(x) - toxicity.PADS + 1)], axis=0) + b)
    return np.maximum(np.concatenate(z), 0) @ net.out + net.out_bias


@pytest.mark.parametrize("at_once", [5, 1 << 15])
def test_hashes_and_logits_of_words(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", at_once)
    clean = langid.all_letters(odd_texts())
    plain = toxicity.word_rows
    want = [plain(w) for c in clean for w in c.split()]
    net = toxicity.TextCNN.fresh(2)
    net.bias = [np.random.default_rng(i).normal(size=toxicity.FILTERS).astype(np.float32) for i in range(len(toxicity.SPANS))]
    logits = [plain_logit(net, c) for c in clean]

    def refused(word):
        raise AssertionError("words are hashed one by one")

    monkeypatch.setattr(toxicity, "word_rows", refused)
    rows, words = toxicity.token_rows(clean)
    assert words.tolist() == [len(c.split()) for c in clean] and [tuple(r) for r in rows.T.tolist()] == want
    assert np.allclose(toxicity.Scorer(net).logits(clean), logits, atol=1e-5) and len(toxicity.Scorer(net).logits([])) == 0
    at = np.cumsum(words) - words
    assert all(toxicity.word_table(c) == np.array(want[a : a + n], np.uint16).tobytes() for c, a, n in zip(clean, at, words))
