"""Toxicity scores from a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows for the whole word and its first 3, 4 and 5 letters. Filters of widths
1, 2 and 3 run over the words of the whole text; each filter's maximum goes through a linear layer to one logit. The
network is trained on a bounded sample of labelled rows, of which only the numbers of embedding rows reach the driver:
at most ``SAMPLE_EACH`` of each class, those with the smallest hashes of their ids, none longer than ``SAMPLE_CHARS``.
The logit's threshold is calibrated for each language, as
recognised from the text by the centroids of :mod:`loomgraph.llm.langid`, so that score 0.5 is the threshold. All
labelled rows that are not held out count for it, as a histogram of their logits.

Defined cases: a null or empty text, or one without letters, has score 0: nothing in it can be toxic; rows whose label,
key or text is null are never learned from; without learning rows of both classes every score is 0; repeated rows are
learned from as often as they occur; texts are read whole; columns named score or predicted are replaced, others
pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.columns import quoted, unused
from loomgraph.functions.storage import discard, stash
from loomgraph.llm import langid
from loomgraph.llm.langid import CHUNK, CentroidModel, all_letters
from loomgraph.llm.text import by_weight, held_out, map_rows

BUCKETS, WIDTH, FILTERS, SPANS = 1 << 15, 12, 12, (1, 2, 3)
#: Labelled rows of each class that the network learns from, at most, and characters of the longest of them.
SAMPLE_EACH, SAMPLE_CHARS = 5_000, 20_000
#: Rows that the language finder draws for its centroids.
FINDER_ROWS = 1_600
EPOCHS, BATCH, RATE = 4, 32, 0.08
#: Embedding rows of a word.
PARTS = 4
#: Padding after each text: a filter of the largest width fits in it.
PADS = max(SPANS)
#: Words whose hashes are computed at once, and bytes of a word that are hashed in arrays; longer words are hashed one by one.
WORDS_AT_ONCE, ARRAY_BYTES = 1 << 15, 64
MIN_CALIBRATION = 20
#: Steps of a logit in the histogram, and the largest one that it tells apart.
STEPS, MOST = 64, 100


def word_rows(word: str) -> tuple[int, int, int, int]:
    """Embedding rows of a word: itself and its beginnings. Row 0 is padding."""
    parts = ("=" + word, "<" + word[:3], "<" + word[:4] + ".", "<" + word[:5] + "..")
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 for p in parts)


def _crc_steps() -> np.ndarray:
    """What each byte does to a CRC-32 register."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


CRC = _crc_steps()


def _after(register: np.ndarray, byte) -> np.ndarray:
    """CRC-32 registers after one more byte of each."""
    return CRC[(register ^ byte) & np.uint32(255)] ^ (register >> np.uint32(8))


def _registers(text: bytes) -> list[int]:
    """The CRC-32 register after each byte."""
    return [zlib.crc32(text[: i + 1]) ^ 0xFFFFFFFF for i in range(len(text))]


#: The register after "<", and by what the registers of a word after "<" and after "=" differ, by the word's bytes: a CRC is linear.
OPEN = np.uint32(_registers(b"<")[0])
WHOLE = np.array([a ^ b for a, b in zip(_registers(b"<" + bytes(ARRAY_BYTES)), _registers(b"=" + bytes(ARRAY_BYTES)))], dtype=np.uint32)


def token_rows(clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_rows` of each word of cleaned texts, one text after another, as (PARTS, words), and the words of each text."""
    words = np.array([max(c.count(" ") - 1, 0) for c in clean], dtype=np.int64)
    raw = "".join(clean).encode("utf-8", "surrogatepass")
    byte = np.frombuffer(raw, dtype=np.uint8)
    rows = np.zeros((PARTS, int(words.sum())), dtype=np.int64)
    if not rows.size:
        return rows, words
    space = byte == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if len(raw) == sum(map(len, clean)):
        cuts = [np.minimum(ends - starts, k) for k in (3, 4, 5)]
    else:  # bytes of the first characters
        first = (byte & 0xC0) != 0x80
        chars, where = np.cumsum(first), np.flatnonzero(first)
        cuts = [where[np.minimum(chars[starts] - 1 + k, chars[ends] - 1)] - starts for k in (3, 4, 5)]
    for s in range(0, len(starts), WORDS_AT_ONCE):
        some = slice(s, s + WORDS_AT_ONCE)
        rows[:, some] = _word_rows(raw, byte, starts[some], ends[some], [c[some] for c in cuts])
    return rows, words


def _word_rows(raw: bytes, byte: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The rows of the words between ``starts`` and ``ends``, whose first 3, 4 and 5 characters have ``cuts`` bytes."""
    size = ends - starts
    short = np.minimum(size, ARRAY_BYTES).astype(np.uint8)
    order = np.argsort(np.uint8(ARRAY_BYTES) - short, kind="stable")  # longest first: those with another byte are in front
    start, short = starts[order], short[order].astype(np.int64)
    longer = len(short) - np.cumsum(np.bincount(short, minlength=ARRAY_BYTES + 1))
    register = np.empty((int(short[0]) + 1, len(short)), dtype=np.uint32)
    register[0] = OPEN
    for i in range(int(short[0])):
        n = int(longer[i])
        register[i + 1, :n] = _after(register[i, :n], byte[start[:n] + i])
    at = np.arange(len(short))
    three, four, five = (register[c[order], at] for c in cuts)
    dot = np.uint32(ord("."))
    hashes = ~np.stack([register[short, at] ^ WHOLE[short], three, _after(four, dot), _after(_after(five, dot), dot)])
    for i in np.flatnonzero(size[order] > ARRAY_BYTES):
        hashes[0, i] = zlib.crc32(b"=" + raw[start[i] : ends[order[i]]])
    out = np.empty(hashes.shape, dtype=np.int64)
    out[:, order] = hashes % np.uint32(BUCKETS - 1) + np.uint32(1)
    return out


@dataclass
class TextCNN:
    emb: np.ndarray
    filters: list[np.ndarray]  # (span * WIDTH, FILTERS) for each span
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    state: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def fresh(seed: int = 0) -> TextCNN:
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        emb[0] = 0
        filters = [rng.normal(0, 1 / np.sqrt(n * WIDTH), (n * WIDTH, FILTERS)).astype(np.float32) for n in SPANS]
        return TextCNN(emb, filters, [np.zeros(FILTERS, np.float32) for _ in SPANS], rng.normal(0, 0.2, len(SPANS) * FILTERS).astype(np.float32))

    def _adagrad(self, name: str, param: np.ndarray, grad: np.ndarray, rows=None) -> None:
        seen = self.state.setdefault(name, np.full_like(param, 0.01))
        if rows is None:
            seen += grad * grad
            param -= RATE * grad / np.sqrt(seen)
        else:
            seen[rows] += grad * grad
            param[rows] -= RATE * grad / np.sqrt(seen[rows])

    def learn(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """One step. docs: the embedding rows of each word of each text (0: padding)."""
        pads = np.zeros((PADS, PARTS), dtype=docs[0].dtype)
        rows = np.concatenate([p for d in docs for p in (d, pads)] + [pads])
        starts = np.concatenate([[0], np.cumsum([len(d) + PADS for d in docs])])[:-1]
        ends = starts + np.array([len(d) for d in docs]) + 1
        x = self.emb[rows].sum(axis=1)
        pooled, where = [], []
        for n, w, b in zip(SPANS, self.filters, self.bias, strict=True):
            wide = np.concatenate([x[i : len(x) - n + 1 + i] for i in range(n)], axis=1)
            h = wide @ w + b
            at = np.stack([s + h[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
            where.append(at)
            pooled.append(h[at, np.arange(FILTERS)])
        z = np.concatenate(pooled, axis=1)
        act = np.maximum(z, 0)
        logit = act @ self.out + self.out_bias
        err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weights / len(docs)).astype(np.float32)
        d_act = np.outer(err, self.out) * (z > 0)
        self._adagrad("out", self.out, act.T @ err)
        self.out_bias -= RATE * float(err.sum())
        touched, grads = [], []
        for k, (n, w, at) in enumerate(zip(SPANS, self.filters, where, strict=True)):
            g = d_act[:, k * FILTERS : (k + 1) * FILTERS]
            dw = np.zeros_like(w)
            for i in range(n):
                part = x[at + i]  # docs x FILTERS x WIDTH
                dw[i * WIDTH : (i + 1) * WIDTH] = np.einsum("dfw,df->wf", part, g)
                back = g[:, :, None] * w[i * WIDTH : (i + 1) * WIDTH].T[None]
                touched.append(rows[at + i].reshape(-1, PARTS))
                grads.append(back.reshape(-1, WIDTH))
            self._adagrad(f"w{n}", w, dw)
            self._adagrad(f"b{n}", self.bias[k], g.sum(axis=0))
        at = np.concatenate(touched)
        grad = np.repeat(np.concatenate(grads), at.shape[1], axis=0)
        flat = at.ravel()
        some = (flat > 0) & grad.any(axis=1)
        uniq, inv = np.unique(flat[some], return_inverse=True)
        sums = np.zeros((len(uniq), WIDTH), dtype=np.float32)
        np.add.at(sums, inv, grad[some])
        if len(uniq):
            self._adagrad("emb", self.emb, sums, uniq)


class Scorer:
    """Logits of cleaned texts, ``CHUNK`` texts at a time. All words are hashed and embedded anew: most words of a large
    table are rare, so that looking them up costs more."""

    def __init__(self, net: TextCNN):
        self.net = net
        # of each span, what each offset's word adds to each filter: (offsets * FILTERS, WIDTH)
        self.filters = [np.concatenate([w[i * WIDTH : (i + 1) * WIDTH].T for i in range(n)]) for n, w in zip(SPANS, net.filters, strict=True)]

    def logits(self, clean: list[str]) -> np.ndarray:
        return np.concatenate([self._logits(clean[s : s + CHUNK]) for s in range(0, len(clean), CHUNK)] or [np.zeros(0, np.float32)])

    def _logits(self, clean: list[str]) -> np.ndarray:
        rows, words = token_rows(clean)
        sizes = words + PADS
        starts = np.cumsum(sizes) - sizes
        size, z = int(sizes.sum()), []
        x = np.zeros((size + PADS, WIDTH), dtype=np.float32)
        emb = self.net.emb
        own = emb.take(rows[0], axis=0)
        for r in rows[1:]:
            own += emb.take(r, axis=0)
        x[np.arange(len(own)) + np.repeat(np.arange(len(clean)) * PADS, words)] = own
        # windows begin at a word or at the first padding after it, so none reaches the next text
        edges = np.stack([starts, starts + words + 1], axis=1).ravel()
        for n, w, b in zip(SPANS, self.filters, self.net.bias, strict=True):
            each = w @ x.T  # (offsets * FILTERS, words): long rows
            h = each[:FILTERS, :size]
            for i in range(1, n):
                h += each[i * FILTERS : (i + 1) * FILTERS, i : size + i]
            z.append(np.maximum.reduceat(h, edges, axis=1)[:, ::2] + b[:, None])
        return np.maximum(np.concatenate(z), 0).T @ self.net.out + self.net.out_bias


@dataclass
class ToxicityModel:
    net: TextCNN | None
    langs: CentroidModel | None
    thresholds: dict[str | None, float]
    slope: float = 1.0

    def scores(self, scorer: Scorer, texts: list[str | None]) -> np.ndarray:
        clean = all_letters(texts)
        found = self.langs.nearest(clean)[0]
        at = np.array([self.thresholds.get(x, self.thresholds[None]) for x in found])
        score = 1 / (1 + np.exp(-np.clip(self.slope * (scorer.logits(clean) - at), -30, 30)))
        return np.where([bool(c) for c in clean], score, 0.0)


def best_threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The middle between the two logits at which the weighted errors are fewest."""
    order = np.argsort(logit, kind="stable")
    x, y, w = logit[order], label[order], weight[order]
    # errors if everything from i on is called 1
    missed = np.concatenate([[0], np.cumsum(w * (y == 1))])
    false = (w * (y == 0)).sum() - np.concatenate([[0], np.cumsum(w * (y == 0))])
    errors = missed + false
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    ties = np.concatenate([[False], x[1:] == x[:-1], [False]])
    errors[ties] = np.inf
    least = np.flatnonzero(errors == errors.min())
    return float(edges[least[len(least) // 2]])


def word_table(clean: str) -> bytes:
    """The embedding rows of the words of a cleaned text, as 16-bit numbers."""
    return token_rows([clean])[0].T.astype(np.uint16).tobytes()


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> TextCNN:
    """Train on the embedding rows (words x PARTS) of all texts of the sample."""
    labels = labels.astype(np.float32)
    counts = [int((labels == c).sum()) for c in (0, 1)]
    balance = np.where(labels == 1, len(labels) / (2 * counts[1]), len(labels) / (2 * counts[0]))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    net = TextCNN.fresh(seed)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            net.learn([docs[i] for i in some], labels[some], balance[some])
    net.state.clear()
    return net


def logits(docs: DataFrame, net: TextCNN, finder: CentroidModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with two more: the recognised language, and the logit, null where the
    text has no letter. They are found and logit, lengthened where such a column is there."""
    found, logit = unused(keep, "found", "logit")
    rows = docs.select(*quoted([*keep, *([] if "text" in keep else ["text"])]))
    kind = T.StructType([*[rows.schema[c] for c in keep], T.StructField(found, T.StringType()), T.StructField(logit, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in by_weight(batches, "text", 500_000):
            clean = all_letters(batch.column("text").to_pylist())
            none = np.array([not c for c in clean])
            out = [pa.array(finder.nearest(clean)[0], pa.string()), pa.array(scorer.logits(clean).astype(np.float64), pa.float64(), mask=none)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *out], names=[*keep, found, logit])

    return map_rows(rows, run, kind)


def histogram(scored: DataFrame, flagged: DataFrame) -> DataFrame:
    """(found, toxic, trained, bin, n): how many labelled rows (doc_id, toxic, trained) have their logit in a bin."""
    at = F.floor(F.least(F.greatest("logit", F.lit(-float(MOST))), F.lit(float(MOST))) * STEPS).cast("int")
    # no text is joined, only logits; labels grow with the rows: merged at every size
    both = scored.where("logit is not null").join(flagged.hint("merge"), "doc_id")
    return both.groupBy("found", "toxic", "trained", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def calibrated(found: np.ndarray, toxic: np.ndarray, trained: np.ndarray, bins: np.ndarray, n: np.ndarray) -> dict[str | None, float]:
    """Threshold of each language, and of all under None, from a histogram. Of each class only the rows count that were
    not trained on; where those are fewer than ``MIN_CALIBRATION`` they weigh half of the class, the others the rest."""
    weight = n.astype(np.float64)
    for c in (0, 1):
        own, new = (toxic == c) & trained, (toxic == c) & ~trained
        a, b = weight[own].sum(), weight[new].sum()
        if b >= MIN_CALIBRATION:
            weight[own] = 0
            weight[new] *= (a + b) / b
        elif 0 < b < a:
            weight[own] *= (a + b) / (2 * a)
            weight[new] *= (a + b) / (2 * b)
    logit = (bins + 0.5) / STEPS
    used = weight > 0
    found, toxic, logit, weight, n = found[used], toxic[used], logit[used], weight[used], n[used]
    thresholds = {None: best_threshold(logit, toxic, weight)}
    for lang in set(found):
        some = found == lang
        if min(n[some & (toxic == c)].sum() for c in (0, 1)) >= MIN_CALIBRATION:
            thresholds[lang] = best_threshold(logit[some], toxic[some], weight[some])
    return thresholds


def fit_scored(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH, keep: tuple[str, ...] = ("doc_id",)) -> tuple[ToxicityModel, DataFrame] | None:
    """Learn from labelled rows, none held out, and score: the model, and the stored :func:`logits` of ``docs`` with its
    columns ``keep``, of which doc_id is one. The
    network learns from at most ``sample_each`` rows of each class, chosen by the hash of the id, a fifth of all left
    out; the thresholds from all labelled rows. None if a class has no row."""
    learn = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")
    )
    n = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    share = {c: int(min(1.0, 1.2 * sample_each / x) * (1 << 30)) for c, x in n.items()}
    below = F.col("h") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    # near the bound a few of these are not trained on, and count as if they were
    flagged = learn.select("doc_id", "toxic", "h", (below & (F.col("h") % 5 > 0)).alias("trained"))
    # 4 * sample_each short rows at most are broadcast: those with the smallest hashes
    picked = flagged.where("trained").orderBy("h", "doc_id", "toxic").limit(4 * sample_each).select("doc_id", "toxic", "h")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    full, docs = docs, docs.select("doc_id", "text", lang)
    finder = langid.fit(docs.where("text is not null"), sample_rows=FINDER_ROWS)
    drawn = docs.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id").select("toxic", "h", "text")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_weight(batches, "text"):
            words = pa.array([word_table(c) for c in all_letters(batch.column("text").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("h"), words], names=["toxic", "h", "words"])

    sample = stash(drawn.mapInArrow(tables, "toxic int, h long, words binary"), "sample")
    texts, toxic = [], []
    for c in (0, 1):
        rows = sample.where(F.col("toxic") == c).orderBy("h", "words").limit(sample_each).select("words").toArrow().column("words")
        texts += [np.frombuffer(w.as_buffer(), dtype=np.uint16).reshape(-1, PARTS) for w in rows]
        toxic += [c] * len(rows)
    discard(sample)
    if len(set(toxic)) < 2:
        return None
    net = train(texts, np.array(toxic))
    del texts
    scored = stash(logits(full, net, finder, list(keep)), "logits")
    found, logit = scored.columns[-2:]
    counted = histogram(scored.select("doc_id", F.col(found).alias("found"), F.col(logit).alias("logit")), flagged.drop("h"))
    h = counted.toArrow().sort_by([(c, "ascending") for c in ("found", "toxic", "trained", "bin")])
    columns = [h.column(c).to_numpy() for c in ("found", "toxic", "trained", "bin", "n")]
    if len(set(columns[1].tolist())) < 2:  # no labelled text of a class has a letter
        return None
    columns[2] = columns[2].astype(bool)
    return ToxicityModel(net, finder, calibrated(*columns)), scored


def fit(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH) -> ToxicityModel | None:
    """The model of :func:`fit_scored`."""
    found = fit_scored(docs, labels, sample_each)
    if found is None:
        return None
    discard(found[1])
    return found[0]


def score_of(model: ToxicityModel, found: str, logit: str) -> Column:
    """The score from stored logits."""
    at = F.lit(model.thresholds[None])
    for lang, x in model.thresholds.items():
        at = F.when(F.col(found) == lang, x).otherwise(at) if lang is not None else at
    z = F.least(F.greatest(F.lit(model.slope) * (F.col(logit) - at), F.lit(-30.0)), F.lit(30.0))
    return F.when(F.col(logit).isNull(), 0.0).otherwise(1 / (1 + F.exp(-z)))


def predict(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score and predicted."""
    keep = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    docs = docs.select(*quoted([f.name for f in keep]))
    if model is None:
        return docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.net)
        for batch in by_weight(batches, text, 500_000):
            score = model.scores(scorer, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return map_rows(docs, run, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, in the same columns. Rows are stored beside their logits,
    so texts are scored once and shuffled never."""
    got = fit_scored(docs, labels, keep=tuple(docs.columns))
    if got is None:
        return docs
    model, scored = got
    return scored.where(score_of(model, *scored.columns[-2:]) < 0.5).select(*quoted(docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    got = fit_scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = predict(docs.select("doc_id", "text"), None) if got is None else got[1].select("doc_id", score_of(got[0], "found", "logit").alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
