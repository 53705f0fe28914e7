"""Exact top-k inner-product search with block-at-a-time pruning.

Rows are stored once in ranges of consecutive ids, and a task cuts what it reads into blocks, kept as forward indexes
(the integer vectors of the block). A block stores the smallest and largest component of each dimension and its centre
and radius, so a query's score in the block is at most the smaller of two bounds: the sum over its dimensions of the
better of the two products, and the score of the centre plus the radius times the query's length. A query visits the
blocks of a shard by falling bound and stops when the bound falls below its k-th score. Queries come in batches of
bounded size, which are broadcast in turn; the k-th scores that the first shards have reached are carried to all others.

How much is pruned depends on the vectors: rows that lie together by id are passed over, while in high dimensions
independent components leave no block out (see the README); the result is the same.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; an empty
vector has score 0 with all; shorter vectors are padded by zeros; ties go to the smaller id; a repeated id is one
candidate for each row, and each different vector of a repeated query id is a query of its own, ranked by itself; a
query's own id is never its candidate; an empty table gives an empty result. Scores are exact while a product sum stays
within 63 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.storage import discard, stash

#: Most rows of a shard, queries of a batch, and rows of a block.
SHARD_ROWS, BATCH_ROWS, BLOCK_ROWS = 65_536, 8_192, 256
#: One shard in so many is searched first, for the k-th scores that the others start from.
FIRST = 8
HITS = "query_id long, qv long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component, for rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: finite(x.cast("double")))
    return vectors.where(ok).select(
        F.col(key).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
    )


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in floating point where all partial sums are below 2^53, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(asks: np.ndarray, docs: np.ndarray, starts: range, block_rows: int) -> np.ndarray:
    """(queries x blocks): what a query's score in a block is at most."""
    low = np.stack([docs[s : s + block_rows].min(axis=0) for s in starts])
    high = np.stack([docs[s : s + block_rows].max(axis=0) for s in starts])
    summed = _products(np.maximum(asks, 0), high) + _products(np.minimum(asks, 0), low)
    centre = np.stack([docs[s : s + block_rows].mean(axis=0) for s in starts])
    radius = np.array([np.linalg.norm(docs[s : s + block_rows] - c, axis=1).max() for s, c in zip(starts, centre)])
    length = np.linalg.norm(asks.astype(np.float64), axis=1)
    ball = asks.astype(np.float64) @ centre.T + length[:, None] * radius[None]
    # the second bound is rounded up, by more than a double can be off
    ball = np.minimum(np.ceil(ball + 1 + np.abs(ball) * 1e-9), float(2**62))
    return np.minimum(summed, ball.astype(np.int64))


def search_shard(ids: np.ndarray, docs: np.ndarray, own: np.ndarray, asks: np.ndarray, k: int, block_rows: int = BLOCK_ROWS,
                 floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the best k rows of the shard for each query, by pruned blocks, and the number of pairs scored.
    ``floor``: k-th scores that the queries have elsewhere; rows below them are not needed."""
    starts = range(0, len(docs), block_rows)
    bound = bounds(asks, docs, starts, block_rows)
    order = np.argsort(-bound, axis=1, kind="stable")
    none = -np.iinfo(np.int64).max  # its negation fits
    floor = np.full(len(asks), none) if floor is None else floor
    best = np.full((len(asks), k), none, dtype=np.int64)
    best_id = np.full((len(asks), k), np.iinfo(np.int64).max, dtype=np.int64)
    active, scored = np.arange(len(asks)), 0
    for turn in range(len(starts)):
        block = order[active, turn]
        # a bound equal to the k-th score may still hold a smaller id
        go = bound[active, block] >= np.maximum(best[active, k - 1], floor[active])
        active, block = active[go], block[go]
        if not len(active):
            break
        for b in np.unique(block):
            who = active[block == b]
            s = b * block_rows
            score = _products(asks[who], docs[s : s + block_rows])
            scored += score.size
            cand = np.broadcast_to(ids[s : s + block_rows], score.shape)
            mine = cand == own[who, None]
            score = np.where(mine, none, score)
            cand = np.where(mine, np.iinfo(np.int64).max, cand)
            score, cand = np.hstack([best[who], score]), np.hstack([best_id[who], cand])
            top = np.lexsort((cand, -score), axis=1)[:, :k]
            best[who], best_id[who] = np.take_along_axis(score, top, 1), np.take_along_axis(cand, top, 1)
    return best_id, best, scored


def searched(shards: DataFrame, asked: list, k: int, shard_rows: int, block_rows: int, floor: dict | None = None) -> DataFrame:
    """(query_id, qv, vec_id, score): the best k rows of every shard for each of ``asked`` (id, qv, v)."""
    own = np.array([r["id"] for r in asked], dtype=np.int64)
    names = np.array([r["qv"] for r in asked], dtype=np.int64)
    vectors = [np.array(r["v"], dtype=np.int64) for r in asked]
    start = None if floor is None else np.array([floor.get((r["id"], r["qv"]), -np.iinfo(np.int64).max) for r in asked], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: list[pd.DataFrame]) -> pd.DataFrame:
            ids, docs = np.concatenate([r["id"].to_numpy() for r in rows]), pd.concat([r["v"] for r in rows])
            width = max(int(docs.map(len).max()), max(map(len, vectors)), 1)
            best_id, best, _ = search_shard(ids, _matrix(docs, width), own, _matrix(vectors, width), k, block_rows, start)
            found = best_id != np.iinfo(np.int64).max
            return pd.DataFrame({"query_id": np.repeat(own, k)[found.ravel()], "qv": np.repeat(names, k)[found.ravel()], "vec_id": best_id[found], "score": best[found]})

        rows, held = [], 0
        for batch in batches:
            if len(batch):
                rows.append(batch)
                held += len(batch)
            if held >= shard_rows:
                yield done(rows)
                rows, held = [], 0
        if rows:
            yield done(rows)

    return shards.select("id", "v").mapInPandas(run, HITS)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS,
          batch_rows: int = BATCH_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query; both inputs are (id, v array<long>). The
    vectors of a batch of queries, about ``batch_rows`` of them, pass through the driver; all else stays in the tasks."""
    spark = rows.sparkSession
    n = rows.count()
    # full shards on large inputs; on small ones enough for all cores, of 2,048 rows at least
    parts = max(-(-n // shard_rows), min(spark.sparkContext.defaultParallelism, -(-n // 2_048)), 1)
    shards = stash(rows.repartitionByRange(parts, "id").sortWithinPartitions("id").select("id", "v", F.spark_partition_id().alias("shard")), "shards")
    asks = stash(queries.select("id", "v", F.xxhash64("v").alias("qv")).distinct(), "queries")
    batches = -(-asks.count() // batch_rows)
    first = (F.col("shard") % FIRST) == 0
    best = Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = None
    for b in range(batches):
        asked = asks.where(F.pmod(F.xxhash64("id", "qv"), F.lit(batches)) == b).collect()
        if not asked:
            continue
        head = stash(ranked(searched(shards.where(first), asked, k, shard_rows, block_rows)), "head")
        floor = {(r["query_id"], r["qv"]): r["score"] for r in head.where(F.col("rank") == k).collect()}
        rest = searched(shards.where(~first), asked, k, shard_rows, block_rows, floor)
        part = stash(ranked(head.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score"), "found")
        discard(head)
        out = part if out is None else out.unionByName(part)
    discard(shards, asks)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op1(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for every vec_id divisible by 50."""
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows, rows.where("id % 50 = 0"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, q.e, r.vec_id, list_dot_product(q.e, r.e)::BIGINT AS score
    FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v r ON q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5
"""
