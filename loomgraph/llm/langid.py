"""Language identification by nearest centroid over TF-IDF character n-grams.

A text becomes lower-case letters with single spaces between words; its 1- to 3-grams are hashed to ``DIMS``
dimensions, weighed by (1 + ln tf) * idf and normalised. Each language has several centroids, found by spherical
k-means on a bounded sample of its learning rows; the document frequencies cover all learning rows. The prediction
is the language of the centroid with the largest cosine. A text farther than ``max_distance`` (1 - cosine) from all
centroids is rejected as ``und``. Letters are the characters of the Unicode categories L and, after one, M.

:func:`op8` has to name a learned language for every text with a letter, so there nothing is rejected: its
``max_distance`` is 1, which no cosine is beyond.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without a language or key are never
learned from; with no learning row at all everything is ``und``; ties go to the language first in code point order;
repeated rows count as often as they occur; texts are read whole; extra columns pass through ``predict`` except
those named lang_pred or score, which are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.columns import quoted
from loomgraph.functions.storage import stash
from loomgraph.llm.text import by_weight, held_out, map_rows

DIMS = 4096
#: Rows of the k-means sample, for all languages together, and centroids of each language.
SAMPLE_ROWS, CENTROIDS = 4_000, 4
NOT_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
CHUNK = 32


def letters(text: str | None) -> str:
    """Lower-case letters and their marks, words set off by single spaces; empty without a letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {words} " if words and LETTER.search(words) else ""


@functools.cache
def _kinds() -> np.ndarray:
    """1 for each code point of category L, 2 for those of M, 0 for all others."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), dtype=np.uint8)
    for kind, runs in ((1, r"\p{L}+"), (2, r"\p{M}+")):
        for m in regex.finditer(runs, every):
            out[m.start() : m.end()] = kind
    return out


def all_letters(texts: list[str | None]) -> list[str]:
    """:func:`letters` of each text, found in arrays of the code points of ``CHUNK`` texts."""
    kinds, out = _kinds(), []
    for s in range(0, len(texts), CHUNK):
        low = [t.lower() if t else "" for t in texts[s : s + CHUNK]]
        code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = kinds[code]
        word = kind > 0
        keep = word.copy()
        keep[1:] |= word[:-1]  # a word and what comes after it: a space
        ends = np.cumsum([len(t) + 1 for t in low])
        some = np.logical_or.reduceat(kind == 1, ends - [len(t) + 1 for t in low])
        at = np.cumsum(np.add.reduceat(keep, ends - [len(t) + 1 for t in low], dtype=np.int64)).tolist()
        words = np.where(word, code, np.uint32(32))[keep].tobytes().decode("utf-32-le", "surrogatepass")
        out += [f" {words[a:b]}" if x else "" for a, b, x in zip([0, *at], at, some.tolist())]
    return out


def term_counts(texts: list[str | None]) -> np.ndarray:
    """(texts x DIMS) counts of hashed 1- to 3-grams."""
    return clean_counts(all_letters(texts))


def clean_counts(clean: list[str]) -> np.ndarray:
    """The same of texts that :func:`letters` has cleaned."""
    ends = np.cumsum([len(c) for c in clean])
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros((len(clean), DIMS), dtype=np.float32)
    if not total:
        return out
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(clean), dtype=np.int64) * DIMS, np.diff(ends, prepend=0))
    gram = np.zeros(total, dtype=np.uint32)
    bins, start = np.empty(3 * total, dtype=np.int64), 0
    for n in range(min(3, total)):
        last = total - n
        gram = (gram[:last] if n else gram) * np.uint32(0x9E3779B1)
        gram += code[n : n + last]
        gram += np.uint32(n + 1)
        mixed = gram >> np.uint32(15)
        mixed ^= gram
        mixed *= np.uint32(0x85EBCA77)
        mixed >>= np.uint32(20)
        part = bins[start : start + last]
        np.add(row[:last], mixed, out=part)
        for back in range(1, n + 1):  # no n-gram runs over two texts
            over = ends - back
            part[over[(over >= 0) & (over < last)]] = out.size
        start += last
    flat = np.bincount(bins[:start], minlength=out.size + 1)[: out.size]
    return flat.reshape(out.shape).astype(np.float32)


@dataclass
class CentroidModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * self.idf
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def nearest(self, clean: list[str], max_distance: float = 1.0) -> tuple[list[str], np.ndarray]:
        """Language and cosine for each cleaned text."""
        langs, score = [], np.zeros(len(clean))
        for s in range(0, len(clean), CHUNK):
            counts = clean_counts(clean[s : s + CHUNK])
            some = counts.any(axis=1)
            if not self.langs:
                langs += ["und"] * len(counts)
                continue
            cos = np.clip(self.vectors(counts) @ self.centroids.T, 0, 1).astype(np.float64)
            at = cos.argmax(axis=1)
            far = ~some | (1 - cos.max(axis=1) > max_distance)
            langs += ["und" if f else self.langs[i] for i, f in zip(at, far)]
            score[s : s + CHUNK] = np.where(some, cos.max(axis=1), 0)
        return langs, score


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Up to k unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def centroid_model(vectors: np.ndarray, langs: np.ndarray, idf: np.ndarray, k: int = CENTROIDS) -> CentroidModel:
    """Centroids of each language from sampled unit vectors, one language in memory at a time."""
    model = CentroidModel([], np.zeros((0, DIMS), dtype=np.float32), idf.astype(np.float32))
    names, rows = [], []
    for lang in sorted(set(langs)):
        x = vectors[langs == lang].astype(np.float32)
        x = x[x.any(axis=1)]
        if len(x):
            c = spherical_kmeans(x, k)
            rows.append(c)
            names += [lang] * len(c)
    if rows:
        model.langs, model.centroids = names, np.vstack(rows)
    return model


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> CentroidModel:
    """Learn from the rows that have a language and are not held out. One pass over all of them counts document
    frequencies (an array of DIMS sums for each task, summed by dimension) and rows of each language; a second one
    brings the vectors of a sample of at most ``sample_rows`` rows, chosen by the hash of the key, in 16 bits a dimension."""
    learn = docs.where(F.col(lang).isNotNull() & ~held_out(key)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, dtype=np.int64), {}
        for batch in by_weight(batches, "text"):
            texts = batch.column("text").to_pylist()
            for s in range(0, len(texts), CHUNK):
                df += (term_counts(texts[s : s + CHUNK]) > 0).sum(axis=0)
            for x in batch.column("lang").to_pylist():
                n[x] = n.get(x, 0) + 1
        # the first row has the sums of the task, the others its languages
        yield pa.RecordBatch.from_pydict(
            {"lang": [None, *n], "n": [0, *n.values()], "df": [df.tolist(), *[None] * len(n)]},
            schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("df", pa.list_(pa.int64()))]),
        )

    counted = stash(learn.select("lang", "text").mapInArrow(count, "lang string, n long, df array<long>"), "df")
    by_lang = {r["lang"]: r["n"] for r in counted.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(DIMS)
    for r in counted.where("df is not null").select(F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        df[r["pos"]] = r["n"]
    idf = idf_of(df, sum(by_lang.values()))
    each = max(sample_rows // max(len(by_lang), 1), 1)
    # an expected 0.9 of the share of each language, by a threshold on the hash
    below = F.lit(0)
    for x, n in by_lang.items():
        below = F.when(F.col("lang") == x, int(min(1.0, 0.9 * each / n) * (1 << 30))).otherwise(below)

    weigh = CentroidModel([], np.zeros((0, DIMS), dtype=np.float32), idf.astype(np.float32)).vectors

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_weight(batches, "text"):
            texts = batch.column("text").to_pylist()
            for s in range(0, len(texts), CHUNK):
                v = weigh(term_counts(texts[s : s + CHUNK])).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").slice(s, CHUNK), "v": pa.array([r.tobytes() for r in v], pa.binary())})

    sample = learn.where(F.col("h") < below).select("lang", "text").mapInArrow(vectors, "lang string, v binary").limit(sample_rows).toArrow()
    langs = np.array(sample.column("lang").to_pylist(), dtype=object)
    found = np.zeros((len(langs), DIMS), dtype=np.float16)
    for i, v in enumerate(sample.column("v")):
        found[i] = np.frombuffer(v.as_buffer(), dtype=np.float16)
    return centroid_model(found, langs, idf)


def predict(docs: DataFrame, model: CentroidModel, text: str = "text", max_distance: float = 1.0) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score."""
    keep = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    docs = docs.select(*quoted([f.name for f in keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_weight(batches, text):
            langs, score = model.nearest(all_letters(batch.column(text).to_pylist()), max_distance)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return map_rows(docs, run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"))
    # every text with a letter gets a learned language: nothing is farther than 1
    return predict(docs.select("doc_id", "text"), model, max_distance=1.0).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
