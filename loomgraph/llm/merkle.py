"""Merkle manifest of a dataset: leaf hashes, group roots, one root, and each row's proof (DataFrame functions only).

Rows are numbered within their group; the base-8 digits of the number are the path to the row. Blocks of 8^4 consecutive
rows are dealt by (group, block), and then the digits are grouped away one after the other, without another shuffle: a node
holds its up to 8 children as an array of structs, each child holds its own. The hashes of the blocks are the rows of the
next tree above, which is built the same way, and the roots of the groups those of the last. A row's proof comes down again
by a transform, which gives each child the digests left and right of it, and an explode, digit by digit: no join sees
documents, only a block (one row for up to 4,096 documents) is joined with the path above it.

Texts are hashed where they are read; what is shuffled and stored is a key, a group and two digests for each row.

Defined cases: a null field is ``-``, told from any text; null keys come first in their group, null groups first of all; rows
with the same key are ordered by their leaves, equal rows in either order with the same result for both orders; a group of
one row is its own root, and a dataset of one group has that group's root; an empty table gives an empty result; columns
that are not among the fields are ignored, of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import quoted
from loomgraph.functions.ranking import wide_group_rank
from loomgraph.functions.storage import stash

#: Children of a node, and digits of a block.
FAN, DIGITS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """The field as it is hashed: its UTF-8 length and itself, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _children(kids: Column) -> Column:
    return F.concat_ws("", F.transform(kids, lambda k: k["h"]))


def _many(n: Column, level: int) -> Column:
    """There is more than one node of n leaves on a level."""
    return n > FAN**level


def nested(nodes: DataFrame) -> DataFrame:
    """(g, n, r, h, item) -> (g, n, block, h, kids): the nodes of each block of ranks, nested by their digits. ``n`` is the number of
    nodes of the group, ``r`` the rank from 0."""
    names = [f"d{k}" for k in range(DIGITS)]
    digit = [F.pmod(F.floor(F.col("r") / FAN**k), F.lit(FAN)).cast("int").alias(c) for k, c in enumerate(names)]
    out = nodes.select("g", "n", F.floor(F.col("r") / FAN**DIGITS).cast("long").alias("block"), *digit, "h", F.col("item").alias("below")).repartition("g", "block")
    for k, c in enumerate(names):
        out = out.groupBy("g", "n", "block", *names[k + 1 :]).agg(F.array_sort(F.collect_list(F.struct(c, "h", "below"))).alias("below"))
        # the only node of a level is the root already
        out = out.withColumn("h", F.when(_many(F.col("n"), k), F.sha2(_children(F.col("below")), 256)).otherwise(F.col("below")[0]["h"]))
    return out.withColumnRenamed("below", "kids")


def unfolded(blocks: DataFrame, kept: list[str]) -> DataFrame:
    """(n, kids, path, kept...) -> (r, h, item, path, kept...): every node of the blocks, its path extended by the digests beside it, lowest
    level first."""
    out = blocks.withColumn("at", F.col("block"))
    for k in reversed(range(DIGITS)):

        def beside(kid: Column, i: Column) -> Column:
            left = F.concat_ws("", F.transform(F.slice("kids", F.lit(1), i), lambda x: x["h"]))
            right = F.concat_ws("", F.transform(F.slice("kids", i + 2, F.lit(FAN)), lambda x: x["h"]))
            return F.struct(kid.alias("kid"), left.alias("l"), right.alias("r"))

        out = out.select(*kept, "n", "path", "at", F.explode(F.transform("kids", beside)).alias("one"))
        here = F.array(F.struct(F.col("one.l").alias("l"), F.col("one.r").alias("r")))
        out = out.select(
            *kept, "n", F.when(_many(F.col("n"), k), F.concat(here, F.col("path"))).otherwise(F.col("path")).alias("path"),
            (F.col("at") * FAN + F.col(f"one.kid.d{k}")).alias("at"), F.col("one.kid.h").alias("h"), F.col("one.kid.below").alias("kids"),
        )
    return out.select(*kept, F.col("at").alias("r"), "h", F.col("kids").alias("item"), "path")


EMPTY_PATH = "cast(array() as array<struct<l:string,r:string>>)"


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored blocks of the nodes, and (g, block, top, path) from each block to the root of its group."""
    blocks = stash(nested(nodes), "merkle")
    largest = blocks.agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= FAN**DIGITS:
        return blocks, blocks.select("g", "block", F.col("h").alias("top"), F.expr(EMPTY_PATH).alias("path"))
    above = blocks.select("g", F.ceil(F.col("n") / FAN**DIGITS).cast("long").alias("n"), F.col("block").alias("r"), "h", F.lit(None).cast("boolean").alias("item"))
    upper, ups = climbed(above)
    up = unfolded(upper.drop("h").join(ups, ["g", "block"]), ["g", "top"])
    return blocks, up.select("g", F.col("r").alias("block"), "top", "path")


def proofs(rows: DataFrame, group: str, order: list[str], leaf: str, item: list[str]) -> DataFrame:
    """(item columns, leaf, subroot, root, path) of every row of ``rows``: ``group`` and ``leaf`` are columns of strings, ``path`` the
    digests (l, r) left and right of the row's node, level by level from its leaf to the root."""
    # groups by their names' bytes, null first; no group is null from here on
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("g"), F.col(leaf).alias("h"), F.struct(*quoted(order)).alias("by"), F.struct(*quoted(item)).alias("item"))
    named = stash(named, "leaves")
    sizes = named.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ranked = wide_group_rank(named, ["g"], [F.col("by"), F.col("h")]).withColumn("r", F.col("rn") - 1).select("g", "r", "h", "item")
    blocks, ups = climbed(ranked.join(sizes, "g"))
    tops = stash(ups.select("g", "top").distinct(), "subroots")
    groups = tops.count()
    roots = wide_group_rank(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "top"), ["g"], [F.col("name")])
    forest, last = climbed(roots.select("g", F.lit(groups).cast("long").alias("n"), (F.col("rn") - 1).alias("r"), F.col("top").alias("h"), F.struct("name").alias("item")))
    root = unfolded(forest.drop("h").join(last, ["g", "block"]), ["top"])
    root = stash(root.select(F.col("item.name").alias("g"), F.col("top").alias("root"), F.col("path").alias("rest")), "roots")
    ups = ups.join(root, "g").select("g", "block", F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path"))
    out = unfolded(blocks.drop("h").join(ups, ["g", "block"]), ["subroot", "root"])
    return out.select("item.*", F.col("h").alias("leaf"), "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has by its path."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda p: F.concat(p["l"], p["r"])))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """(key, leaf, subroot, root, path) of every row."""
    rows = docs.select(*quoted([key]), *[q.cast("string").alias("g_") for q in quoted([group])], digest(*[field(c) for c in quoted(list(fields))]).alias("leaf_"))
    return proofs(rows, "g_", [key], "leaf_", [key])


def op12(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its perhaps tampered text still verifies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    bent = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = docs.select("doc_id", "lang", digest(*[field(F.col(c)) for c in FIELDS]).alias("leaf"), digest(*[field(F.col(c)) for c in FIELDS[:-1]], field(bent)).alias("bent"))
    out = proofs(rows, "lang", ["doc_id"], "leaf", ["doc_id", "bent"])
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("bent"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a list of bytes, by the rule of its polynomial.
CRC32_SQL = """(xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: list_reduce(
    list_prepend(xor(c, b::BIGINT), [1,1,1,1,1,1,1,1]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295))"""
_BYTES = "list_transform(range(strlen({s})), lambda i: ('0x' || substr(hex(encode({s})), 2 * i::INT + 1, 2))::BIGINT)"
LEVELS = 9


def bytes_sql(text: str) -> str:
    return _BYTES.format(s=text)


def _tree_sql(start: str, name: str) -> str:
    """CTEs <name>0.. of the levels over ``start`` (g, i, h, n), and <name>s0.. with what stands left and right."""
    parts = [f"{name}0 AS (SELECT g, i, h, n FROM {start})"]
    for k in range(LEVELS):
        many = f"n > {FAN**k}"
        parts.append(
            f"{name}s{k} AS (SELECT g, i, {many} AS many, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WINDOW w AS (PARTITION BY g, i // {FAN} ORDER BY i))"
        )
        parts.append(f"{name}{k + 1} AS (SELECT g, i // {FAN} AS i, CASE WHEN {many} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, n FROM {name}{k} GROUP BY g, i // {FAN}, n)")
    return ",\n".join(parts)


def _climb_sql(name: str, out: str, start: str) -> str:
    """CTEs that carry (doc_id, g, i, p, f) of ``start`` up the tree ``name``; the last is ``out``."""
    parts, cur = [], start
    for k in range(LEVELS):
        new = out if k == LEVELS - 1 else f"{out}{k}"
        parts.append(
            f"{new} AS (SELECT c.* REPLACE (c.i // {FAN} AS i, CASE WHEN many THEN p || l || r ELSE p END AS p, CASE WHEN many THEN sha256(l || f || r) ELSE f END AS f) "
            f"FROM {cur} c JOIN {name}s{k} s ON c.g = s.g AND c.i = s.i)"
        )
        cur = new
    return ",\n".join(parts)


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"


_HEAD_SQL = " || ".join(_field_sql(c) for c in FIELDS[:-1])
_CRC_SQL = CRC32_SQL.format(bytes=bytes_sql("doc_id::VARCHAR"))
_BENT_SQL = f"CASE WHEN {_CRC_SQL} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
OP12_SQL = f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_HEAD_SQL} || {_field_sql("text")}) AS h, sha256({_HEAD_SQL} || {_field_sql(_BENT_SQL)}) AS bent FROM documents),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_tree_sql("d", "t")},
subs AS (SELECT g AS name, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t{LEVELS}),
subs1 AS (SELECT '' AS g, i, subroot AS h, n FROM subs),
{_tree_sql("subs1", "u")},
c AS (SELECT doc_id, h AS leaf, g, i, '' AS p, bent AS f FROM d),
{_climb_sql("t", "up", "c")},
v AS (SELECT doc_id, leaf, subroot, '' AS g, subs.i, p, f FROM up JOIN subs ON up.g = subs.name),
{_climb_sql("u", "top", "v")}
SELECT doc_id, leaf, subroot, (SELECT h FROM u{LEVELS}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM u{LEVELS}) AS verified FROM top
"""
