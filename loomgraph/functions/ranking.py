"""Seeded random orders and row numbers.

Where a random generator would draw, rows are ordered by md5 of (seed, key): the same rows come out on every run, in
any partitioning, and in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import unused
from loomgraph.functions.storage import stash


def md5_key(seed, *keys: str) -> Column:
    """md5 of the seed and the keys, joined by ``|``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def md5_bucket(seed, *keys: str, buckets: int) -> Column:
    """Uniform 0..buckets-1 from the first 8 hex digits of :func:`md5_key`."""
    return F.pmod(F.conv(F.substring(md5_key(seed, *keys), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def group_rank(df: DataFrame, group: list[str], order: list, name: str = "rn") -> DataFrame:
    """1-based row number in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def md5_rank(df: DataFrame, seed, key: str, group: list[str], name: str = "rn") -> DataFrame:
    """1-based seeded random rank in each group."""
    return group_rank(df, group, [md5_key(seed, key), F.col(key)], name)


def wide_running_sums(df: DataFrame, group: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """For each (name: column) of ``sums`` the column's sum over the rows of the group up to the row itself, where a group
    may hold most rows: a range partitioning by group and order, a running sum in each partition's part of the group, and
    the sums of the group's parts in the partitions before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pid, *own = unused(df.columns, "pid", *[f"ahead_{k}" for k in range(len(sums))])
    keys = [F.col(g) for g in group]
    dealt = stash(df.repartitionByRange(n, *keys, *order).withColumn(pid, F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and partition
    parts = dealt.groupBy(pid, *group).agg(*[F.sum(c).alias(o) for o, c in zip(own, sums.values(), strict=True)])
    names = unused([*df.columns, pid, *own], *group, "p")
    told = parts.select(pid, *group, *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias(o) for o in own]).toDF(names[-1], *names[:-1], *own)
    same = F.col(pid) == F.col(names[-1])
    for g, other in zip(group, names, strict=False):
        same = same & F.col(g).eqNullSafe(F.col(other))
    here = Window.partitionBy(pid, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = unused([*df.columns, pid, *own, *names], *sums)
    inside = dealt.select("*", *[F.sum(c).over(here).alias(f) for f, c in zip(found, sums.values(), strict=True)])
    out = inside.join(told, same)
    for name, f, o in zip(sums, found, own, strict=True):
        out = out.withColumn(name, F.col(f) + F.col(o))
    return out.drop(pid, *own, *names, *[f for f in found if f not in sums])


def wide_group_rank(df: DataFrame, group: list[str], order: list, name: str = "rn") -> DataFrame:
    """1-based row number in each group where a group may hold most rows."""
    one, = unused(df.columns, "one")
    return wide_running_sums(df.withColumn(one, F.lit(1)), group, order, {name: one}).drop(one)


#: Rows up to which a group is ranked in one task.
NARROW = 100_000


def rank_for(group: list[str], *tables: DataFrame):
    """:func:`group_rank` where no group of the tables has more than ``NARROW`` rows, else :func:`wide_group_rank`."""
    most = [t.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for t in tables]
    return group_rank if max(most) <= NARROW else wide_group_rank


def wide_md5_rank(df: DataFrame, seed, key: str, group: list[str], name: str = "rn") -> DataFrame:
    """1-based seeded random rank in groups of any size."""
    h, = unused(df.columns, "h")
    return wide_group_rank(df.withColumn(h, md5_key(seed, key)), group, [F.col(h), F.col(key)], name).drop(h)


def first_rows(df: DataFrame, order: list, k: int) -> DataFrame:
    """The ``k`` first rows in order, for a k that grows with the data: no task holds them all."""
    rn, = unused(df.columns, "rn")
    return global_rank(df, order, rn).where(F.col(rn) <= k).drop(rn)


def global_rank(df: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """1-based row number over all rows without a one-task window: a range partitioning, a row number in each
    partition, and the running count of the partitions before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pid, own, before = unused([*df.columns, name], "pid", "own", "before")
    dealt = stash(df.repartitionByRange(n, *order).withColumn(pid, F.spark_partition_id()), "ranges")
    ahead = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    parts = dealt.groupBy(pid).agg(F.count(F.lit(1)).alias(own))
    offsets = parts.select(pid, F.coalesce(F.sum(own).over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(pid).orderBy(*order)
    ranked = dealt.withColumn(own, F.row_number().over(inside)).join(F.broadcast(offsets), pid)
    return ranked.withColumn(name, F.col(before) + F.col(own)).drop(pid, own, before)


def seeded_rank(df: DataFrame, seed, key: str, name: str = "rn") -> DataFrame:
    """1-based seeded random rank over all rows."""
    h, = unused([*df.columns, name], "h")
    return global_rank(df.withColumn(h, md5_key(seed, key)), [F.col(h), F.col(key)], name).drop(h)
