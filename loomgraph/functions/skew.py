"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import quoted, unused

#: Rows of a partition that a task sorts or aggregates at once.
TASK_ROWS = 1_000_000
#: A key with more than one in so many of all rows is hot; so there are fewer hot keys than this.
HOT_KEYS = 1_000


def spread(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """``rows``, of which a later step makes ``total``, dealt by the keys into as many partitions as keep a task's share at about ``TASK_ROWS``;
    as they are, where the session's number of partitions does. So a task's memory does not grow with the table."""
    parts = -(-total // TASK_ROWS)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def join_by_count(rows: DataFrame, per_key: DataFrame, on: list[str], total: int, n: str = "n", how: str = "inner", largest: int | None = None) -> DataFrame:
    """``rows`` joined with ``per_key``: one row for each key, in ``n`` how many of the ``total`` rows have it.

    Rows of hot keys stay where they are: the keys' rows are broadcast, and there are at most ``HOT_KEYS`` of them,
    because their counts sum to ``total`` at most. All others are shuffled, and none of their keys can fill a task.
    ``how`` is inner or left_semi; ``n`` is not in the result, null keys find nothing. Without a hot key it is a plain
    join: the largest count is looked up first unless given, so ``per_key`` should be stored or cheap.
    """
    if largest is None:
        largest = per_key.agg(F.max(n).alias("n")).first()["n"] or 0
    if largest * HOT_KEYS <= total:
        return rows.join(per_key.drop(n), on, how)
    flag, = unused([*rows.columns, *per_key.columns], "hot")
    hot = per_key.where(F.col(n) * HOT_KEYS > total).drop(n).withColumn(flag, F.lit(True))
    cold = per_key.where(F.col(n) * HOT_KEYS <= total).drop(n)
    # both branches read the same broadcast; null keys find nothing in either
    marked = rows.join(F.broadcast(hot), on, "left")
    here = marked.where(F.col(flag)).drop(flag)
    there = marked.where(F.col(flag).isNull()).select(*quoted(rows.columns)).join(cold, on, how)
    return (here.select(*quoted(there.columns)) if how == "inner" else here.select(*quoted(rows.columns))).unionByName(there)
