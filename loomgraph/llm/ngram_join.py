"""N-gram Jaccard self-join by MinHash banding.

A document is the set of its 5-word shingles. Documents with equal sets form one class and are joined once. Each class
has a MinHash signature cut into bands; the number of bands and rows is chosen for a target recall at the threshold.
Classes are shuffled on their band hashes. A class is named by its smallest row; the smallest class of each bucket
links its members, and a component of these links tells which classes are verified side by side. Pairs are verified
on the full shingle sets, as matrix products inside tasks. A component too large for a task is dealt into blocks, so
that classes with the same smallest bucket partner share one, and a pair of blocks is a task only where a bucket has
members in both. So no group is gathered whole and no pair becomes a row: a task returns, for each class, how many
documents it is linked to and its smallest linked class.

Hot keys (a bucket, a class of copies, a component) are joined by :func:`loomgraph.functions.skew.join_by_count`.

Defined cases: fewer than five words make one shingle of all words; a text that is null or has no words has no links
and is a class of its own, as is a row without an id; repeated rows are copies of each other; equal similarity to the
threshold is a link; texts are read whole; an empty table gives an empty result; other columns, whatever their names,
pass through ``deduplicated``. A threshold or recall that no bands reach is an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import quoted, unused
from loomgraph.functions.fixpoint import connected_components
from loomgraph.functions.skew import join_by_count
from loomgraph.functions.storage import discard, stash
from loomgraph.llm.substrings import Powers, WordHashes, _words, mixed, packed
from loomgraph.llm.text import by_weight

SHINGLE, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 256
#: Shingles and classes of a block of a component, so of half a task's input, about.
BLOCK_SHINGLES, BLOCK_CLASSES = 1_000_000, 4_096


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands whose chance to catch a pair at the threshold reaches the recall."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("the threshold lies in (0, 1], the recall in (0, 1)")
    best = None
    for rows in range(1, most + 1):
        alike = threshold**rows
        bands = 1 if alike == 1 else math.ceil(math.log1p(-recall) / math.log1p(-alike)) if alike > 1e-12 else most + 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no {most} hashes reach a recall of {recall} at {threshold}")
    return best


def shingles(words: list[bytes], hashes: WordHashes, powers: Powers, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    at = hashes.of(words)
    return np.unique(mixed(powers.rolling(hashes.wide[at], min(size, len(words)))))


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(2_024)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands_of(self, shingle: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band of the signature of a non-empty set."""
        low = (shingle >> np.uint64(32)).astype(np.uint32)
        sig = np.full(len(self.mul), 0xFFFFFFFF, dtype=np.uint32)
        for s in range(0, len(low), 2_048):
            part = low[s : s + 2_048, None] * self.mul
            part += self.add
            np.minimum(sig, part.min(axis=0), out=sig)
        grid = sig.astype(np.uint64).reshape(self.bands, self.rows)
        number = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(mixed((grid + np.uint64(1)) * self.mix[None]).sum(axis=1, dtype=np.uint64) + number).view(np.int64)


#: The name of a class: id and hash of its smallest row.
ROW, NAME = "struct<id:bigint,rid:bigint>", pa.struct([("id", pa.int64()), ("rid", pa.int64())])


def signatures(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, rid, sh, n, bands) of every row with an id and a word; ``sh`` is a hash of its shingle set."""
    some = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.xxhash64(key, text).alias("rid"), F.col(text).alias("t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, signer = WordHashes(), Powers(), MinHash(bands, rows)
        for b in by_weight(batches, "t"):
            keep, sh, n, out = [], [], [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                found = shingles(t.encode("utf-8", "surrogatepass").split(), hashes, powers, size)
                if len(found):
                    keep.append(i)
                    sh.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    n.append(len(found))
                    out.append(signer.bands_of(found))
            if keep:
                at = pa.array(keep)
                off = pa.array(np.arange(len(keep) + 1) * bands, pa.int32())
                lists = pa.ListArray.from_arrays(off, pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(at), b.column("rid").take(at), pa.array(sh, pa.binary()), pa.array(n, pa.int64()), lists],
                    names=["id", "rid", "sh", "n", "bands"],
                )

    return some.mapInArrow(run, "id long, rid long, sh binary, n long, bands array<long>")


def links_within(sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Verify the pairs between rows ``left`` and rows ``right`` (equal: all pairs among them). Returns the summed
    weights of each row's partners and each row's smallest row number in its group of links."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    kind = np.float32 if sizes.max() < 2**24 else np.float64  # counts stay whole
    value, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    shared = np.bincount(at, minlength=len(value)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total, inter = int(shared.sum()), np.zeros((len(left), len(right)), dtype=kind)
    width = max(256, 4_000_000 // m)
    for c in range(0, total, width):
        a, b = np.searchsorted(at, [c, c + width])
        grid = np.zeros((m, min(width, total - c)), dtype=kind)
        grid[row[a:b], at[a:b] - c] = 1
        inter += grid[left] @ grid[right].T
    # |a & b| >= t * (|a| + |b| - |a & b|) in whole numbers, t as a fraction: a tie is a link at every length
    p, q = Fraction(str(threshold)).limit_denominator(1_000_000).as_integer_ratio()
    hit = np.empty(inter.shape, dtype=bool)
    for s in range(0, len(left), 256):
        both = np.rint(inter[s : s + 256]).astype(np.int64)
        hit[s : s + 256] = (p + q) * both >= p * (sizes[left[s : s + 256], None] + sizes[right][None])
    del inter
    same = left is right or (len(left) == len(right) and (left == right).all())
    if same:
        np.fill_diagonal(hit, False)
    gained = np.zeros(m)
    for s in range(0, len(left), 256):  # a product of booleans and numbers would copy the grid as numbers
        part = hit[s : s + 256].astype(np.float64)
        gained[left[s : s + 256]] += part @ weights[right]
        if not same:
            gained[right] += weights[left[s : s + 256]] @ part
    place = np.arange(m)
    while True:  # smallest row number over links
        side_l, side_r = place[left], place[right]
        best_l = np.minimum(side_l, np.where(hit, side_r[None].astype(np.int32), np.int32(m)).min(axis=1, initial=m))
        best_r = np.minimum(side_r, np.where(hit, side_l[:, None].astype(np.int32), np.int32(m)).min(axis=0, initial=m))
        new = place.copy()
        np.minimum.at(new, left, best_l)
        np.minimum.at(new, right, best_r)
        new = new[new]
        if (new == place).all():
            return gained.astype(np.int64), place
        place = new


def verified(tasks: DataFrame, threshold: float) -> DataFrame:
    """(first, links, low) from (c, i, j, blk, first, copies, s): rows arrive sorted by task, and only the rows of the
    task at hand are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, rows):
            rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])
            blk = np.array([r[0] for r in rows])
            left, right = np.flatnonzero(blk == key[1]), np.flatnonzero(blk == key[2])
            if len(rows) < 2 or not len(left) or not len(right):
                return
            sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
            links, low = links_within(sets, np.array([r[2] for r in rows], dtype=np.float64), left, right, threshold)
            some = np.flatnonzero(links)
            if len(some):
                name = lambda at: pa.array([{"id": rows[k][1][0], "rid": rows[k][1][1]} for k in at], NAME)
                yield pa.RecordBatch.from_arrays([name(some), pa.array(links[some]), name(low[some])], names=["first", "links", "low"])

        key, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("c", "i", "j", "blk", "first", "copies", "s")]
            for c, i, j, blk, first, copies, s in zip(*cols, strict=True):
                c = (c["id"], c["rid"])
                if (c, i, j) != key:
                    yield from done(key, rows) if key else ()
                    key, rows = (c, i, j), []
                rows.append((blk, (first["id"], first["rid"]), copies, s))
        yield from done(key, rows) if key else ()

    return tasks.mapInArrow(run, f"first {ROW}, links long, low {ROW}")


def blocks(reps: DataFrame, banded: DataFrame, buckets: DataFrame, comps: DataFrame, n_rows: int,
           block_shingles: int, block_classes: int) -> tuple[DataFrame, DataFrame]:
    """((first, sh, copies, c, blk, parts), (c, blk, others)): the block of each class that has a bucket partner, and
    for each block of a component of several those that it is compared with, in ``others`` as pairs (i, j)."""
    linked = reps.join(comps, reps["first"] == comps["node"]).select("first", "copies", "n", F.col("component").alias("c"))
    linked = stash(linked, "linked")
    per = linked.groupBy("c").agg(
        F.ceil(F.greatest(F.sum("n") / block_shingles, F.count(F.lit(1)) / block_classes)).cast("int").alias("parts"), F.count(F.lit(1)).alias("m")
    )
    sized = stash(join_by_count(linked, per, ["c"], n_rows, "m"), "sized")
    one = sized.where("parts = 1").select("first", "copies", "c", F.lit(0).alias("blk"))
    large = sized.where("parts > 1")
    # classes go by their smallest bucket partner; one that would fill half a block by itself is dealt by class
    member = banded.join(large.select("first"), "first", "left_semi")
    home = join_by_count(member, buckets, ["band"], n_rows, "members").groupBy("first").agg(F.min("low").alias("home"))
    homed = stash(large.join(home, "first"), "homes")
    heavy = homed.groupBy("home").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("m")).select(
        "home", "m", ((F.col("w") * 2 > block_shingles) | (F.col("m") * 2 > block_classes)).alias("heavy")
    )
    by = F.when(F.col("heavy"), F.xxhash64("first")).otherwise(F.xxhash64("home"))
    dealt = stash(
        join_by_count(homed, heavy, ["home"], n_rows, "m").select("first", "copies", "c", F.pmod(by, F.col("parts")).cast("int").alias("blk")), "dealt"
    )
    touched = member.join(dealt.select("first", "c", "blk"), "first").groupBy("band").agg(F.first("c").alias("c"), F.collect_set("blk").alias("blks"))
    pairs = touched.select("c", F.explode("blks").alias("i"), "blks").select("c", "i", F.explode("blks").alias("j")).where("i <= j").distinct()
    ends = pairs.select("c", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"), F.struct("i", "j").alias("p"))
    others = ends.groupBy("c", "blk").agg(F.collect_set("p").alias("others"))
    placed = one.unionByName(dealt)
    return stash(placed, "placed"), stash(others, "pairs")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
            recall: float = RECALL, block_shingles: int = BLOCK_SHINGLES, block_classes: int = BLOCK_CLASSES) -> tuple[DataFrame, DataFrame]:
    """((id, rid, sh) of the rows with words, (sh, first, copies, n_links, root) of their classes): the number of other
    documents that each is linked to, and the smallest row that links lead to."""
    bands, per_band = banding(threshold, recall)
    signed = stash(signatures(docs, key, text, size, bands, per_band), "signed")
    reps = stash(
        signed.groupBy("sh").agg(F.min(F.struct("id", "rid")).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("bands").alias("bands")),
        "classes",
    )
    banded = reps.select("first", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # merged at every size: whether Spark would broadcast depends on the rows at hand
    buckets = stash(shared, "buckets").hint("merge")
    n_rows = reps.count() * bands
    edges = join_by_count(banded, buckets, ["band"], n_rows, "members").where("first <> low").select("first", "low").distinct()
    comps = connected_components(edges, "first", "low")
    placed, pairs = blocks(reps, banded, buckets, comps, n_rows, block_shingles, block_classes)
    members = placed.select(F.col("first.id").alias("id"), F.col("first.rid").alias("rid"), "first", "copies", "c", "blk")
    # the first row of a class may be repeated, so the join may yield its set again: the tasks drop repeats
    texts = packed(docs, key, text).join(members.hint("merge"), ["id", "rid"]).select("z", "first", "copies", "c", "blk")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for b in batches:
            s = pa.array([shingles(_words(z), hashes, powers, size).tobytes() for z in b.column("z").to_pylist()], pa.binary())
            rest = [c for c in b.schema.names if c != "z"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], s], names=[*rest, "s"])

    full = texts.mapInArrow(sets, f"first {ROW}, copies long, c {ROW}, blk int, s binary")
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    tasks = full.join(pairs, ["c", "blk"], "left").withColumn("p", F.explode(F.coalesce("others", alone))).select(
        "c", "p.i", "p.j", "blk", "first", "copies", "s"
    )
    found = stash(
        verified(tasks.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j"), threshold), "links"
    )
    links = found.groupBy("first").agg(F.sum("links").alias("links"))
    settled = connected_components(found.where("first <> low"), "first", "low")
    roots = settled.select(F.col("node").alias("first"), F.col("component").alias("root"))
    info = links.join(roots, "first", "left")
    every = reps.select("sh", "first", "copies").join(info, "first", "left").select(
        "sh", "first", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "first").alias("root")
    )
    out = stash(signed.select("id", "rid", "sh"), "rows"), stash(every, "every")
    discard(signed, reps, placed, pairs, found)
    return out


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, class_id, n_links) of every row: the smallest id that similar pairs lead to, and the number of other rows
    that are similar to this one, equal ones included."""
    signed, every = classes(docs, key, text, **how)
    named = every.select("sh", F.col("root.id").alias("class_id"), "n_links", "copies")
    out = join_by_count(signed, named.hint("merge"), ["sh"], signed.count(), "copies").select("id", "class_id", "n_links")
    wordless = docs.where(F.col(key).isNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return out.unionByName(
        wordless.select(F.col(key).cast("long").alias("id"), F.col(key).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` in its own columns with one row of each group of similar documents: the one with the smallest id.
    Rows without an id or a word stay."""
    _, every = classes(docs, key, text, **how)
    rid, first_id, first_rid = unused(docs.columns, "rid", "first_id", "first_rid")
    first = every.where("first = root").select(F.col("first.id").alias(first_id), F.col("first.rid").alias(first_rid))
    wordless = F.col(key).isNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumn(rid, F.xxhash64(key, text))
    kept = rows.where(~wordless).join(first, (F.col(key) == F.col(first_id)) & (F.col(rid) == F.col(first_rid)))
    return kept.dropDuplicates([key, rid]).select(*quoted(docs.columns)).unionByName(docs.where(wordless))


def op4(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join(docs).withColumnRenamed("id", "doc_id")
