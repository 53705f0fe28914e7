"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a 40-bit hash of its key. For each source the words are summed by hash bucket; the bucket in
which the running sum passes the source's budget is refined by the next bits, three times in all. What comes out
is one hash cutoff per source, so that documents are chosen by a comparison: nothing is sorted, and a larger
budget always takes a superset of what a smaller one takes. The state, one row for each source, is stored between
the levels.

Defined cases: a null text has 0 words and takes nothing; a null source is a source of its own, after all others;
repeated rows share their hash and are taken together; an empty table gives an empty mix; columns of the input
that have the name of an output column (size, source_size, target, taken) are replaced, all others pass through; a
null key hashes as an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import quoted, unused
from loomgraph.functions.storage import stash

#: Bits of each histogram level: 4,096 buckets, then 16,384 in the boundary bucket, twice.
LEVELS = (12, 14, 14)
WORDS = r"[^\x20\x09-\x0D]+"
MADE = ("size", "source_size", "target", "taken")


def word_count(text: str | Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def hash40(key: str) -> Column:
    """The first 40 bits of the key's md5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 10), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> plus ``target``: shares of ``share`` x all words by weight, none above
    ``cap`` x its own words; what is cut off is shared again by weight among the others.

    Sources are capped in the order of cap / weight. ``level`` is what a unit of weight gets when exactly the
    sources before this one are capped; the first at which this one is not above its cap is the water level. The
    windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn(
        "w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    )
    limits = ranked.withColumn("lim", F.lit(cap) * F.col("source_size")).withColumn("fill", F.col("lim") / F.col("w"))
    levels = limits.withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("lim").over(before), F.lit(0.0)))
        / F.sum("w").over(after),
    )
    water = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source", "level"))).over(everything)
    return levels.withColumn("water", water["level"]).select(
        "source",
        "source_size",
        F.least("lim", F.coalesce(F.col("water") * F.col("w"), F.col("lim"))).alias("target"),
    )


def hash_cutoffs(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``times`` that all its documents are taken, and ``cutoff`` below which one more time.

    ``sized`` has source, size, h (40 bits). The last cell is taken if that brings the sum nearer to the budget.
    """
    state = targets.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("times"),
    ).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    state = stash(state.withColumn("cell", F.lit(0).cast("long")), "budgets")
    used = 0
    for bits in LEVELS:
        part = F.shiftright("h", 40 - used - bits)
        # the documents of the boundary cell so far, summed by the next bits
        inside = sized.select("source", "size", "h", F.shiftright("h", 40 - used).alias("at")).alias("d")
        if used:
            here = state.select(F.col("source").alias("s"), "cell").alias("b")
            inside = inside.join(here, F.col("d.source").eqNullSafe(F.col("b.s")) & (F.col("d.at") == F.col("b.cell")))
        cells = inside.groupBy("source", part.alias("next")).agg(F.sum("size").alias("sum"))
        run = Window.partitionBy("source").orderBy("next")
        cells = cells.withColumn("upto", F.sum("sum").over(run)).select(F.col("source").alias("s"), "next", "sum", "upto")
        met = (
            state.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") > F.col("need")), "left")
            .groupBy("source", "source_size", "target", "times", "need", "cell")
            .agg(F.min(F.struct("next", "sum", "upto")).alias("edge"))
        )
        used += bits
        state = stash(
            met.select(
                "source",
                "source_size",
                "target",
                "times",
                (F.col("need") - F.coalesce(F.col("edge.upto") - F.col("edge.sum"), F.lit(0))).alias("need"),
                F.coalesce(F.col("edge.next"), F.lit(0).cast("long")).alias("cell"),
                F.coalesce(F.col("edge.sum"), F.lit(0)).alias("words"),
            ),
            "budgets",
        )
    nearer = F.col("need") * 2 > F.col("words")
    return state.select(
        "source", "source_size", "target", "times", (F.col("cell") + F.when(nearer, 1).otherwise(0)).alias("cutoff")
    )


def measured(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, h) of every document."""
    return docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), hash40(key).alias("h")
    )


def cutoffs(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, times, cutoff) of each source of the stored output of :func:`measured`."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return hash_cutoffs(sized, source_targets(sizes, weights, share, cap))


def applied(rows: DataFrame, cut: DataFrame, source: str, size: str, h: str) -> DataFrame:
    """``rows`` (with their size and hash in the named columns) plus size, source_size, target and taken."""
    rest = [c for c in rows.columns if c.lower() not in MADE and c not in (size, h)]
    of, total, goal, times, below = unused([*rows.columns, *MADE], "of", "total", "goal", "times", "below")
    told = cut.toDF(of, total, goal, times, below)
    taken = F.col(size) * (F.col(times) + F.when(F.col(h) < F.col(below), 1).otherwise(0))
    return rows.join(told, F.col(source).eqNullSafe(F.col(of)), "left").select(
        *quoted(rest), F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(goal).alias("target"), taken.cast("long").alias("taken")
    )


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id",
        source: str = "source", text: str = "text") -> DataFrame:
    """All rows of ``docs`` plus size, source_size, target and ``taken``: the words that the mix takes of each
    document, repeats counted."""
    cut = cutoffs(stash(measured(docs, key, source, text), "mix"), weights, share, cap)
    size, h = unused([*docs.columns, *MADE], "n", "h")
    rows = docs.select("*", word_count(text).alias(size), hash40(key).alias(h))
    return applied(rows, cut, source, size, h)


def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = stash(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix")
    rows = sized.withColumnRenamed("size", "n")
    return applied(rows, cutoffs(sized), "source", "n", "h").select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
f AS (SELECT *, 2.0 * source_size AS lim, 2.0 * source_size / w AS fill FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY fill, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY fill, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(lim, coalesce((SELECT level FROM l WHERE level <= fill ORDER BY fill,
    source NULLS LAST LIMIT 1) * w, lim)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t),
n AS (SELECT *, target - times * source_size AS need FROM b),
c AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
    FROM d GROUP BY source, h),
e AS (SELECT n.source, min(h) AS h FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source AND upto > need GROUP BY 1),
k AS (SELECT n.*, e.h + CASE WHEN (need - (upto - words)) * 2 > words THEN 1 ELSE 0 END AS cutoff
    FROM n LEFT JOIN e ON n.source IS NOT DISTINCT FROM e.source
    LEFT JOIN c ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.h)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
    (size * (times + CASE WHEN d.h < coalesce(cutoff, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
