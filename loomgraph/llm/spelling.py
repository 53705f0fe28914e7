r"""Spelling variants of corpus words by permuterm rotations (DataFrame functions only).

A word with a terminator has a rotation for each of its characters. Two words that differ in one character have rotations
that begin behind that character and are the same but for their last; a word with one character less has a whole rotation
that equals the other's but for its last. So each word emits, for each of its characters, the rotation that ends with it,
under the prefix before it, and each whole rotation under itself; rotations are dealt and sorted by prefix, and a scan of the
sorted rows emits the pairs of each prefix. A prefix has at most one whole rotation, and one row for each other character
of the alphabet: at most 91 rows, however often the words occur.

Words come as counts: every run of letters of every text is counted before anything is compared, and the shuffle sees
partial counts alone. Each word keeps its best neighbour (largest count, then code-point order); following these, counts
grow by ``ratio`` each step, so a chain is short and is walked by a few joins of the words that still have a step to go.

Defined cases: a null text has no words, a null key is an empty string in the hash; equal counts go to the smaller word;
repeated rows count as often as they stand; an empty table gives an empty result; columns other than key and text, of any
name, are ignored. Words hold letters alone, so the terminator cannot occur in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import quoted
from loomgraph.functions.storage import discard, stash
from loomgraph.llm.merkle import CRC32_SQL, LOWER, UPPER, bytes_sql

#: Fixed values of the words: their letters, least code points and occurrences, and how much more frequent a form is.
LETTERS, LEAST_CHARS, LEAST_N, RATIO = r"[A-Za-zÀ-ÿ]+", 6, 5, 5
END = "$"
#: One in so many (key, run) pairs loses a character.
THINNED = 199


def thinned(run: Column, key: Column, one_in: int = THINNED) -> Column:
    """The run, without one character where ``one_in`` divides the hash of key and run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, one_in: int = THINNED) -> DataFrame:
    """(word, n) of all words of at least ``least_chars`` code points that occur ``least_n`` times or more."""
    of, body = quoted([key, text])
    runs = docs.select(of.alias("key"), F.explode(F.regexp_extract_all(body, F.lit(LETTERS), F.lit(0))).alias("run"))
    lowered = runs.select("key", F.translate("run", UPPER, LOWER).alias("run")).where(F.length("run") >= least_chars)
    words = lowered.select(thinned(F.col("run"), F.col("key"), one_in).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, word, n): for each character the rotation that ends with it, split there, and all whole rotations."""
    marked, size = F.concat("word", F.lit(END)), F.length("word")
    turned = lambda i: F.concat(F.substring(marked, i + 2, size), F.substring(marked, F.lit(1), i))  # noqa: E731  without character i
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(turned(i).alias("prefix"), F.substring("word", i + 1, F.lit(1)).alias("last")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        F.concat(F.substring(marked, i + 1, size + 1), F.substring(marked, F.lit(1), i)).alias("prefix"), F.lit("").alias("last")))
    return words.select(F.inline(F.concat(cut, whole)), "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, m): all ordered pairs of words that differ by one inserted, deleted or replaced character; a pair that differs
    so in several ways is met several times. Rotations are dealt by prefix and sorted; a window passes over the sorted rows
    and gives each the words of its prefix, 91 at most."""
    scan = Window.partitionBy("prefix").orderBy("last").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = rotations(words).withColumn("all", F.collect_list(F.struct(F.col("word").alias("near"), F.col("n").alias("m"))).over(scan))
    return met.where(F.size("all") > 1).select("word", "n", F.inline("all")).where("word <> near")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): the near words of each word counted, and its form."""
    met = neighbours(words).distinct().groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    best = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    return words.join(met, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best["near"].alias("form"), (-best["m"]).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """``found`` of :func:`forms` (stored) plus ``root``. Each round doubles the steps that a word has looked ahead."""
    step = stash(found.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stash(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        moved = new.where("moved").limit(1).count()
        discard(step)
        step = new.drop("moved")
        step._stash_path, step._stash_table = new._stash_path, None
        if not moved:
            break
    return found.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = stash(word_counts(docs, key, text, **limits), "words")
    found = stash(forms(words), "forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op13(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_HASH_SQL = CRC32_SQL.format(bytes=bytes_sql("coalesce(doc_id::VARCHAR, '') || ':' || run"))
OP13_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
hashed AS (SELECT *, {_HASH_SQL} AS h FROM once),
cut AS (SELECT CASE WHEN h % {THINNED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_N}),
holes AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS z FROM holes),
near AS (SELECT x.word, x.n, y.word AS near, y.n AS m FROM less x JOIN less y ON x.a = y.a AND x.z = y.z AND x.i = y.i AND x.word <> y.word
    UNION SELECT x.word, x.n, y.word, y.n FROM less x JOIN words y ON x.a || x.z = y.word
    UNION SELECT y.word, y.n, x.word, x.n FROM less x JOIN words y ON x.a || x.z = y.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, encode(near)) AS near, max(m) AS m FROM near GROUP BY word),
found AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * w.n THEN near END AS form, CASE WHEN m >= {RATIO} * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM found
    UNION ALL SELECT walk.word, walk.next, found.form FROM walk JOIN found ON walk.next = found.word)
SELECT f.word, form, root, n, n_near, form_n FROM found f JOIN walk ON f.word = walk.word AND walk.next IS NULL
"""
