"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may occur in a document with up to ``budget(n)`` edits. It is split into one piece more than
that, so at least one piece occurs unchanged. Exact piece hits are found by one automaton over all pieces; around
each hit the item is verified by Myers' bit-parallel distance, with the pattern's bits in one integer.

Texts and items are compared in lower case with runs of white space as one space.

The items are sent to the tasks in blocks of about ``BLOCK_CHARS`` characters, one pass over the documents for each.
Only one block is on the driver at a time: the results of a pass are stored before the next block is read.

Defined cases: null and empty items match nothing, nor do null texts; an item too short for one edit must occur
exactly; repeated rows are reported as often as they occur, each id of a repeated item once; the span is the first of
those with the least distance; texts are read whole; an empty table gives an empty result; other columns pass through
``clean`` and are ignored otherwise. Item ids may have any type that a string can be cast back to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import discard, stash
from loomgraph.llm.text import by_weight, map_rows

#: Share of an item's characters that may differ, and characters of items in a pass.
EDIT_SHARE, BLOCK_CHARS = 0.06, 4_000_000
SPACES = re.compile(r"\s+")


def normalised(text: str | None) -> str:
    return SPACES.sub(" ", text.lower()).strip() if text else ""


def budget(n: int, share: float = EDIT_SHARE) -> int:
    """Allowed edits of an item of n characters."""
    return int(n * share)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of near equal length with their offsets."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text`` and the end of the first such substring."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & mask)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        plus = mh | (~(xv | ph) & mask)
        minus = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds the items of a block in normalised texts."""

    def __init__(self, items: list[tuple[str, str]], share: float = EDIT_SHARE):
        self.items = [(k, t) for k, t in items if t]
        self.edits = [budget(len(t), share) for _, t in self.items]
        self.bits = [bits(t) for _, t in self.items]
        self.back = [bits(t[::-1]) for _, t in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(self.items):
            for at, piece in pieces(t, self.edits[i]):
                found.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.auto.add_word(piece, (len(piece), uses))
        if found:
            self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end) of every item within its budget."""
        if not text or not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.auto.iter(text):
            for i, at in uses:
                start, e = last + 1 - size - at, self.edits[i]
                windows.setdefault(i, []).append((max(0, start - e), min(len(text), start + len(self.items[i][1]) + e)))
        out = []
        for i, spans in windows.items():
            item, e = self.items[i][1], self.edits[i]
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:  # overlapping windows are verified once
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                at = text.find(item, a, b)
                if at >= 0:
                    got = (0, at, at + len(item))
                elif not e:
                    continue
                else:
                    d, end = myers(self.bits[i], len(item), text[a:b])
                    if d > e:
                        continue
                    # the same distance backwards from the end gives the start
                    low = max(a, a + end - len(item) - e)
                    _, back = myers(self.back[i], len(item), text[low : a + end][::-1])
                    got = (d, a + end - back, a + end)
                if best is None or got[0] < best[0]:
                    best = got
            if best:
                out.append((i, *best))
        return out


def n_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> int:
    """Blocks that the items make."""
    return -(-(benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // block_chars)


def item_block(benchmark: DataFrame, at: int, blocks: int) -> list[tuple[str, str]]:
    """The distinct normalised items of a block, chosen by the hash of the text; ids as strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("text is not null").distinct()
    rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == at).collect()
    return sorted({(r["id"] or "", r["id"] is None, normalised(r["text"])) for r in rows})


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, span_start, span_end): each item that occurs in a document within its budget,
    with the span in the normalised text."""
    docs = docs.select("doc_id", F.col("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string, distance int, span_start long, span_end long"
    blocks, out = n_blocks(benchmark, block_chars), None
    for at in range(blocks):
        items = item_block(benchmark, at, blocks)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(None if null else k, t) for k, null, t in items], share)
            for batch in by_weight(batches, "text"):
                row, hits = [], []
                for r, text in enumerate(batch.column("text").to_pylist()):
                    for i, d, a, b in matcher.matches(normalised(text)):
                        row.append(r)
                        hits.append((matcher.items[i][0], d, a, b))
                if row:
                    cols = list(zip(*hits, strict=True))
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                        names=["doc_id", "item_id", "distance", "span_start", "span_end"],
                    )

        part = docs.mapInArrow(run, schema)
        if at < blocks - 1:  # the pass is over before the next block is read
            part = stash(part, "items")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("item_id", F.col("item_id").cast(benchmark.schema["item_id"].dataType))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, in the same columns."""
    blocks, out, old = n_blocks(benchmark, block_chars), docs, None
    for at in range(blocks):
        items = item_block(benchmark, at, blocks)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(k, t) for k, _, t in items], share)
            for batch in by_weight(batches, "text"):
                keep = np.array([not matcher.matches(normalised(t)) for t in batch.column("text").to_pylist()], dtype=bool)
                yield batch.filter(pa.array(keep))

        out = map_rows(out, run, out.schema)
        if at < blocks - 1:
            new = stash(out, "clean")
            if old is not None:
                discard(old)
            out = old = new
    return out


def op2(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
