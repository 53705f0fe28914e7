"""Wavelet-matrix token files: the matrix, the encoder against the tokenizer itself, and files of small corpora."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.storage import folders, shared_folder
from loomgraph.llm import token_files as W

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    return W._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n,bits,chunk", [(0, 3, 8), (1, 1, 8), (1000, 16, 64), (4096, 5, 512), (777, 17, 1 << 12)])
def test_matrix(n, bits, chunk):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % (1 << bits)).astype(np.uint32)
    sizes = [n // 3, n - n // 3]
    docs = pa.table({"key": pa.array([None, 7], pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
    out = io.BytesIO()
    assert W.write_matrix(out, ids, bits, docs, chunk) == len(out.getvalue())
    f = W.TokenFile(out)
    assert f.n == n and f.ids().tolist() == ids.tolist() and f.docs.column("key").to_pylist() == [None, 7]
    assert [f.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
    for t in {*ids[:9].tolist(), 0, (1 << bits) - 1, 1 << bits}:
        where = np.flatnonzero(ids == t)
        assert f.count(t) == len(where) and f.occurrences(t).tolist() == where.tolist()
        lo, hi = n // 5, n - n // 7
        part = where[(where >= lo) & (where < hi)]
        assert f.count(t, lo, hi) == len(part) and f.occurrences(t, lo, hi).tolist() == part.tolist()


piece = st.sampled_from(["a", "the", "it's", "'ll", " ", "  ", "\n", " \n", "\t", "\x85", " ", " ", "\x1c", "é", "你好", "123", "!?", ".", "'", "_", "A1", "x,y.\nZ", "word.\n", "ÿ", "×", "\x1f", "ß", "<|endoftext|>", "́", "\U0001f600", "x" * 70])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(piece, max_size=12).map("".join), min_size=1, max_size=5))
def test_encoder_equals_tokenizer(texts):
    ids, counts = W.PieceEncoder(PATH).encode(pa.array(texts))
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [plain_ids(t) for t in texts]


def test_encoder_forgets_and_takes_nulls():
    enc = W.PieceEncoder(PATH, remembered=3)
    for _ in range(3):
        ids, counts = enc.encode(pa.array([None, "", "one two three four five", "one"]))
        assert counts[:2].tolist() == [0, 0] and ids.tolist() == plain_ids("one two three four five") + plain_ids("one")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, `Key` string")


def test_files_of_a_corpus(spark):
    rows = [(i, " ".join(f"w{j % 17}" for j in range(i % 40)), "x") for i in range(300)]
    rows += [(5, "again", "x"), (5, "again", "x"), (None, None, None), (None, "no key", ""), (10**12, "<|endoftext|>  tail ", "y"), (-3, "word " * 5000, "z")]
    man = W.write_files(docs(spark, rows), PATH, shard_tokens=500, partitions=3)
    files = man.orderBy("start").collect()
    assert len(files) > 5 and [f["start"] for f in files] == np.cumsum([0] + [f["n_tokens"] for f in files])[:-1].tolist()
    got = sorted(W.read_documents(man, T.LongType(), with_ids=True).collect(), key=lambda r: r["start"])
    h = {r["text"]: r["h"] for r in docs(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, h[r[1]]))
    at = 0
    for r, (key, text, _) in zip(got, want, strict=True):
        ids = plain_ids(text) + [2]
        assert (r["key"], r["start"], r["n_tokens"], r["ids"]) == (key, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    every = [i for r in got for i in r["ids"]]
    some = [2, 2, every[30], 50256]
    assert {r["token"]: r["n"] for r in W.count_tokens(man, some).collect()} == {t: every.count(t) for t in some}
    found = W.find_tokens(man, [every[30]], T.LongType()).collect()
    assert sorted(r["place"] for r in found) == [i for i, t in enumerate(every) if t == every[30]]
    keys = {r["start"]: r["key"] for r in got}
    assert all(r["key"] == keys[max(s for s in keys if s <= r["place"])] for r in found)


def test_string_keys_empty_tables_and_lost_attempts(spark):
    named = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "zero")], "id string, body string")
    folder = shared_folder(spark) + "/token-test"
    man = W.write_files(named, PATH, folder=folder, key="id", text="body")
    # a lost attempt's file is in the folder, but in no manifest
    fs, at = W.opened(folder)
    with fs.open_output_stream(at + "/part-000000-0000-999999.lwm") as out:
        out.write(b"half a file")
    assert len(folders(spark, folder)) == man.count() + 1
    assert [r["key"] for r in W.read_documents(man, T.StringType()).orderBy("start").collect()] == [None, "a", "b"]
    none = W.write_files(named.where("false"), PATH, key="id", text="body")
    assert none.count() == 0 and W.read_documents(none, T.StringType()).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = W.op11(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    at = 0
    for r, d in zip(got.orderBy("doc_id").collect(), spark.read.parquet(f"{folder}/documents.parquet").orderBy(F.col("doc_id")).collect(), strict=True):
        ids = plain_ids(d["text"]) + [2]
        assert tuple(r) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
