"""Substring deduplication with a log-structured index of fingerprints.

A window is ``WINDOW`` consecutive words. Each window is represented by its smallest hash of ``ANCHOR`` consecutive
words inside it (its anchor): equal windows have equal anchors, and neighbouring windows mostly share theirs, so a
document needs few fingerprints. The index is a folder of immutable runs. A run has the postings of a batch (the
anchors of each document) and two bucketed tables sorted by hash: how many documents have an anchor, and the smallest
document with a given whole text. A new batch is merge-joined with the runs and with itself; anchors that another
document has are hits. The batch then becomes a run, and where there are too many they are merged into one.
The folder can be opened again by another application, which then reads old texts only of documents with a hit.

Hits are verified on the windows themselves: only windows with a hit anchor are hashed, by two independent 64-bit
hashes of all their words, the smallest document of each pair of hashes is found by a partially aggregated minimum,
and a window is repeated if that document is smaller than its own. Whole copies of a document are settled beforehand
by a 128-bit digest of their text. Words covered by a repeated window are removed. Texts are compressed and dealt into
buckets once; candidates and results are joined with those buckets. Hot keys (a text, an anchor, a window that many
documents have) are joined by :func:`loomgraph.functions.skew.join_by_count`.

Defined cases: a null text has no words; a null id is neither smaller nor larger than any, so its document is kept
whole and removes nothing; rows that repeat an id do not remove each other's words; texts shorter than a window are
kept; texts are read whole; an empty table gives an empty result; other columns, whatever their names, pass through
``deduplicated``. In an index only the documents of the new batch are judged: by smaller ids, old or new.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.columns import quoted
from loomgraph.functions.skew import join_by_count
from loomgraph.functions.storage import _delete, discard, folders, open_bucketed, shared_folder, stash, stash_bucketed
from loomgraph.llm.text import by_weight

WINDOW, ANCHOR = 50, 12
#: Batches by id that a full table is fed to the index in, and runs above which it is compacted.
BATCHES, MAX_RUNS = 2, 1
KEPT_WORDS = 500_000
BASE = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """Word -> two 64-bit hashes, as row numbers of two growing arrays."""

    def __init__(self):
        super().__init__()
        self.wide = np.zeros(1024, dtype=np.uint64)
        self.check = np.zeros(1024, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.wide):
            self.wide, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.wide, self.check))
        both = xxhash.xxh3_128_intdigest(word)
        self.wide[i], self.check[i] = both & (2**64 - 1), both >> 64
        self[word] = i
        return i

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class Powers:
    """Powers of the base and of its inverse, modulo 2^64."""

    def __init__(self):
        self.n = 0
        self.need(1 << 12)

    def need(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            step = np.full(self.n, BASE, dtype=np.uint64)
            back = np.full(self.n, pow(BASE, -1, 2**64), dtype=np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)

    def rolling(self, x: np.ndarray, size: int) -> np.ndarray:
        """Hash of every ``size`` consecutive values."""
        self.need(len(x) + 1)
        sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * self.up[: len(x)], out=sums[1:])
        return (sums[size:] - sums[:-size]) * self.down[: len(x) - size + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_anchors(wide: np.ndarray, powers: Powers, window: int, anchor: int) -> np.ndarray:
    """The anchor of every window of a document of at least ``window`` words."""
    return sliding_min(mixed(powers.rolling(wide, anchor)), window - anchor + 1)


def _words(z: bytes) -> list[bytes]:
    return zstandard.decompress(z).split()


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", rest: bool = False) -> DataFrame:
    """(id, rid, z[, rest]): each row with its text compressed, with ``rest`` also its other columns and whether the
    text was null. ``rid`` tells rows apart; equal rows share it."""
    others = F.struct(*quoted([c for c in docs.columns if c != text])) if len(docs.columns) > 1 else F.struct()
    more = [F.struct(others.alias("row"), F.col(text).isNull().alias("null")).alias("rest")] if rest else []
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(key, text).alias("rid"), F.coalesce(text, F.lit("")).alias("t"), *more)
    kind = T.StructType([f for f in rows.schema.fields if f.name != "t"] + [T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3).compress
        for b in by_weight(batches, "t"):
            z = pa.array([press(t.encode("utf-8", "surrogatepass")) for t in b.column("t").to_pylist()], pa.binary())
            names = [n for n in b.schema.names if n != "t"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], z], names=[*names, "z"])

    return rows.mapInArrow(run, kind)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, rid, whole, a): the anchors of every row of at least a window of words; ``whole`` hashes all its words."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.xxhash64(key, text).alias("rid"), F.col(text).alias("t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for b in by_weight(batches, "t"):
            ids, rids, whole, out = [], [], [], []
            for i, r, t in zip(b.column("id").to_pylist(), b.column("rid").to_pylist(), b.column("t").to_pylist(), strict=True):
                words = t.encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                at = hashes.of(words)
                wide = hashes.wide[at]
                ids.append(i)
                rids.append(r)
                whole.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                out.append(np.unique(window_anchors(wide, powers, window, anchor)).astype(np.int64))
            if ids:
                off = pa.array(np.concatenate([[0], np.cumsum([len(o) for o in out])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(off, pa.array(np.concatenate(out), pa.int64()))],
                    names=["id", "rid", "whole", "a"],
                )

    return rows.mapInArrow(run, "id long, rid long, whole binary, a array<long>")


class FingerprintIndex:
    """Immutable runs in ``folder``: run-<number>-<buckets> with ``anchors`` (a, n) and ``wholes`` (whole, low), bucketed
    and sorted, and posts-<number> (id, rid, whole, a). A run exists from the moment its postings are written.
    Without a folder the index lives in the application's own folder."""

    ANCHORS, WHOLES = "a bigint, n bigint", "whole binary, low bigint"

    def __init__(self, spark: SparkSession, folder: str | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.max_runs = spark, max_runs
        self.folder = folder or f"{shared_folder(spark)}/loom-{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        names = folders(spark, self.folder)
        runs = sorted((int(x.split("-")[1]), int(x.split("-")[2])) for x in names if x.startswith("run-") and x.endswith("-done"))
        if runs:  # one number of buckets for all runs: merge joins need no shuffle
            self.buckets = runs[0][1]
        self.next = max([int(x.split("-")[1]) for x in names], default=0) + 1
        self.runs = [self._open(n) for n, _ in runs]
        self.posts = [n for n in names if n.startswith("posts-")]

    def _path(self, number: int, kind: str) -> str:
        return f"{self.folder}/run-{number}-{self.buckets}-{kind}"

    def _open(self, number: int) -> tuple[int, DataFrame, DataFrame]:
        return (
            number,
            open_bucketed(self.spark, self._path(number, "anchors"), self.ANCHORS, ["a"], self.buckets),
            open_bucketed(self.spark, self._path(number, "wholes"), self.WHOLES, ["whole"], self.buckets),
        )

    def _write(self, anchors: DataFrame, wholes: DataFrame) -> tuple[int, DataFrame, DataFrame]:
        number, self.next = self.next, self.next + 1
        run = (
            number,
            stash_bucketed(anchors, ["a"], "anchors", self.buckets, self._path(number, "anchors")),
            stash_bucketed(wholes, ["whole"], "wholes", self.buckets, self._path(number, "wholes")),
        )
        # the mark that makes the run complete
        self.spark.range(1).write.mode("overwrite").parquet(self._path(number, "done"))
        return run

    def postings(self) -> DataFrame:
        """(id, rid, whole, a) of every document of the index that is no copy of a smaller one."""
        kind = "id bigint, rid bigint, whole binary, a array<bigint>"
        paths = [f"{self.folder}/{p}" for p in self.posts]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def add(self, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Merge-join a batch (id, rid, whole, a) with the runs, then make it one. Returns ((id, rid) of the rows that are
        copies of a smaller document, (a, n): the anchors of the batch that several documents have, and how many)."""
        total = prints.count()
        own = prints.groupBy("whole").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
        for _, _, old in self.runs:
            own = own.join(old.hint("merge").withColumnRenamed("low", "old"), "whole", "left").select("whole", F.least("low", "old").alias("low"), "n")
        own = stash(own, "wholes")
        marked = stash(join_by_count(prints, own, ["whole"], total), "marked")
        copies = marked.where("id > low").select("id", "rid").distinct()
        # a copy has the windows of its original: neither its anchors nor its windows are needed
        number = self.next
        kept = marked.where("id = low").select("id", "rid", "whole", "a")
        kept.write.parquet(f"{self.folder}/posts-{number}")
        self.posts.append(f"posts-{number}")
        posted = self.spark.read.schema(kept.schema).parquet(f"{self.folder}/posts-{number}")
        counted = posted.select("id", F.explode("a").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        run = self._write(counted, own.select("whole", "low"))
        found = run[1]
        for _, old, _ in self.runs:
            found = found.join(old.hint("merge").withColumnRenamed("n", "more"), "a", "left").select("a", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        hits = stash(found.where("n > 1"), "hits")
        copies = stash(copies, "copies")
        discard(own, marked)
        self.runs.append(run)
        if len(self.runs) > self.max_runs:
            self.compact()
        return copies, hits

    def compact(self) -> None:
        """Merge all runs into one; the old ones are deleted afterwards. Postings stay as they are."""
        old = self.runs
        (_, anchors, wholes), *rest = old
        for _, a, w in rest:  # sorted runs of the same buckets: merge joins without a shuffle
            anchors = anchors.join(a.hint("merge").withColumnRenamed("n", "more"), "a", "full").select(
                "a", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n")
            )
            wholes = wholes.join(w.hint("merge").withColumnRenamed("low", "other"), "whole", "full").select("whole", F.least("low", "other").alias("low"))
        self.runs = [self._write(anchors, wholes)]
        for number, a, w in old:
            _delete(self.spark, self._path(number, "done"))
            discard(a, w)

    def drop(self) -> None:
        """Delete the index."""
        discard(*[t for _, *both in self.runs for t in both])
        _delete(self.spark, self.folder)


def batch_edges(rows: DataFrame, batches: int) -> list[int]:
    """Ids that cut the rows into about equal batches."""
    cuts = rows.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    return sorted({int(c) for c in cuts})


def repeated_starts(texts: DataFrame, postings: DataFrame, hits: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, rid, starts): in each document the first words of the windows that a smaller one has too. ``texts``: (id,
    rid, z); of them only those with a hit anchor (a, n) are read."""
    counted = stash(postings.select("id", "rid", F.explode("a").alias("a")), "posted")
    wanted = join_by_count(counted, hits, ["a"], counted.count(), how="left_semi").groupBy("id", "rid").agg(F.collect_set("a").alias("a"))
    candidates = texts.where("id is not null").join(wanted, ["id", "rid"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for b in batches:
            for i, r, z, a in zip(b.column("id").to_pylist(), b.column("rid").to_pylist(), b.column("z").to_pylist(), b.column("a"), strict=True):
                at = hashes.of(_words(z))
                wide, check = hashes.wide[at], hashes.check[at]
                hit = np.flatnonzero(np.isin(window_anchors(wide, powers, window, anchor).view(np.int64), a.values.to_numpy()))
                full, second = (mixed(powers.rolling(h, window))[hit].view(np.int64) for h in (wide, check))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array(second), pa.array(np.full(len(hit), i)), pa.array(np.full(len(hit), r)), pa.array(hit.astype(np.int32))],
                    names=["w", "v", "id", "rid", "at"],
                )

    found = stash(
        candidates.select("id", "rid", "z", "a").mapInArrow(windows, "w long, v long, id long, rid long, at int"), "windows"
    )
    lowest = found.groupBy("w", "v").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    lowest = stash(lowest.select("w", "v", "low", "n"), "lowest")
    repeated = join_by_count(found, lowest, ["w", "v"], found.count()).where("low < id")
    out = stash(repeated.groupBy("id", "rid").agg(F.collect_set("at").alias("starts")), "starts")
    discard(counted, found, lowest)
    return out


def flagged(copies: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, rid, copy, starts), one row for each row that loses words."""
    both = copies.select("id", "rid", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts")).unionByName(
        starts.select("id", "rid", F.lit(False).alias("copy"), "starts")
    )
    return both.groupBy("id", "rid").agg(F.max("copy").alias("copy"), F.first("starts", ignorenulls=True).alias("starts"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_windows(docs: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                     anchor: int = ANCHOR, batches: int = BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """(id, rid, copy, starts): which rows of a whole table are copies of a smaller document, and in the others the first
    words of the windows that a smaller document has too. The table is fed to an index of its own in batches by id."""
    prints = stash(fingerprints(docs, key, text, window, anchor), "prints")
    index, found = FingerprintIndex(docs.sparkSession, max_runs=max_runs), []
    edges = [None, *batch_edges(prints, batches), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = prints
        part = part.where(F.col("id") > low) if low is not None else part
        part = part.where(F.col("id") <= high) if high is not None else part
        found.append(index.add(part))
    # an anchor may be a hit of several batches: the last count covers all of them
    hits = _union([h for _, h in found]).groupBy("a").agg(F.max("n").alias("n"))
    starts = repeated_starts(texts, index.postings(), hits, window, anchor)
    out = stash(flagged(_union([c for c, _ in found]), starts), "flags")
    index.drop()
    discard(prints, starts, *[t for both in found for t in both])
    return out


def removed_of(texts: DataFrame, flags: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, rid, n_words, n_removed, kept_sha256) of every row of ``texts`` (id, rid, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for z, copy, starts in zip(b.column("z").to_pylist(), b.column("copy").to_pylist(), b.column("starts"), strict=True):
                total, words = _kept_words(z, copy, starts, window)
                n.append(total)
                gone.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("rid"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                names=["id", "rid", "n_words", "n_removed", "kept_sha256"],
            )

    joined = texts.join(flags, ["id", "rid"], "left").select("id", "rid", "z", "copy", "starts")
    return joined.mapInArrow(run, "id long, rid long, n_words long, n_removed long, kept_sha256 string")


def add_batch(index: FingerprintIndex, new: DataFrame, old: DataFrame | None, key: str = "doc_id", text: str = "text",
              window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Judge the documents of a new batch against all that the index has and make the batch a run. (id, rid, n_words,
    n_removed, kept_sha256) of each row of ``new``. ``old`` has the texts of the documents in the index; only rows with
    a hit anchor are joined and hashed."""
    copies, hits = index.add(fingerprints(new, key, text, window, anchor))
    texts = stash_bucketed(packed(new, key, text), ["id", "rid"], "texts")
    both = texts if old is None else texts.unionByName(packed(old, key, text))
    starts = repeated_starts(both, index.postings(), hits, window, anchor)
    flags = stash(flagged(copies, starts), "flags")
    discard(copies, hits, starts)
    return removed_of(texts, flags, window)


def covered(n: int, starts: list[int] | np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    delta = np.zeros(n + 1, dtype=np.int64)
    at = np.asarray(starts, dtype=np.int64)
    delta[at] += 1
    np.subtract.at(delta, at + window, 1)
    return np.cumsum(delta[:n]) > 0


def _kept_words(z: bytes, copy: bool | None, starts, window: int) -> tuple[int, list[bytes]]:
    """Number of words and those that stay."""
    words = _words(z)
    if copy:
        return len(words), []
    if not starts.is_valid:
        return len(words), words
    drop = covered(len(words), starts.values.to_numpy(), window)
    return len(words), [w for w, d in zip(words, drop.tolist(), strict=True) if not d]


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """(id, rid, n_words, n_removed, kept_sha256) of every row."""
    texts = stash_bucketed(packed(docs, key, text), ["id", "rid"], "texts")
    return removed_of(texts, repeated_windows(docs, texts, key, text, window, anchor, batches), window)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """``docs`` in its own columns with the repeated words taken out of its texts; rows of which nothing is left are
    dropped, and n_chars, where there is one, follows the new text. Texts without repeats stay as they are."""
    whole = stash_bucketed(packed(docs, key, text, rest=True), ["id", "rid"], "texts")
    flags = repeated_windows(docs, whole.select("id", "rid", "z"), key, text, window, anchor, batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, changed = [], [], []
            for i, (z, copy, starts) in enumerate(zip(b.column("z").to_pylist(), b.column("copy").to_pylist(), b.column("starts"), strict=True)):
                total, words = _kept_words(z, copy, starts, window)
                if total and not words:
                    continue
                at.append(i)
                changed.append(len(words) < total)
                texts.append((b" ".join(words) if changed[-1] else zstandard.decompress(z)).decode("utf-8", "surrogatepass"))
            rest = b.column("rest").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rest, pa.array(texts, pa.string()), pa.array(changed, pa.bool_())], names=["rest", "t", "changed"])

    joined = whole.join(flags, ["id", "rid"], "left").select("rest", "z", "copy", "starts")
    kind = T.StructType([joined.schema["rest"], T.StructField("t", T.StringType()), T.StructField("changed", T.BooleanType())])
    new = joined.mapInArrow(run, kind)
    cols = []
    for f in docs.schema.fields:
        old = F.col("rest")["row"][f.name]
        if f.name == text:
            c = F.when(~F.col("rest.null"), F.col("t"))
        elif f.name == "n_chars":
            c = F.when(F.col("changed"), F.length("t").cast(f.dataType)).otherwise(old)
        else:
            c = old
        cols.append(c.alias(f.name))
    return new.select(*cols)


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
