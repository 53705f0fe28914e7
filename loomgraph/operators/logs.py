"""Vote and usage logs. A vote row has type, tstamp (seconds), models[2] and states[2] of struct(model_name, offset,
messages array<array<string>>)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import local_time, quoted

# Vote types, their outcomes, and the words that give a model away.
OUTCOMES = {"leftvote": "model_a", "rightvote": "model_b", "tievote": "tie", "bothbad_vote": "tie (bothbad)"}
IDENTITY_WORDS = [
    "vicuna", "lmsys", "koala", "uc berkeley", "open assistant", "laion", "chatglm", "chatgpt", "openai", "anthropic", "claude", "bard", "palm",
    "Lamda", "google", "**NETWORK ERROR DUE TO HIGH TRAFFIC. PLEASE REGENERATE OR REFRESH THIS PAGE.**",
]
TIMEZONE = "America/Los_Angeles"


def strip_html(name: Column) -> Column:
    """T17. ``<h3>..: X</h3>`` and a line end become X."""
    return F.when(name.startswith("<h3>"), F.regexp_extract(name, r"(?s): (.*?)</h3>\n?$", 1)).otherwise(name)


def judged_votes(log: DataFrame, legacy: bool = False) -> DataFrame:
    """All vote rows with the cleaned columns and ``reason``: null for a kept vote, else invalid or leaked.
    ``legacy`` keeps two words with capitals, which never match the lowered messages."""
    v = log.where(F.col("type").isin(list(OUTCOMES)))
    public = [strip_html(F.col("models")[i]) for i in (0, 1)]
    v = v.withColumns({"p0": public[0], "p1": public[1]})
    hidden = F.col("states")[0]["model_name"].isNotNull()
    v = v.withColumns({f"h{i}": F.when(hidden, F.col("states")[i]["model_name"]).otherwise(F.col(f"p{i}")) for i in (0, 1)})
    anony = (F.col("p0") == "") | (F.col("p0") == "Model A")
    first = F.col("states")[0]
    said = F.lower(F.array_join(F.flatten(F.transform("states", lambda s: F.transform(F.slice(s["messages"], s["offset"] + 1, F.greatest(F.size(s["messages"]), F.lit(1))), lambda m: F.coalesce(m[1], F.lit(""))))), ""))
    words = [w if legacy else w.lower() for w in IDENTITY_WORDS]
    leaked = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(said, w))
    invalid = ((F.col("p0") == "") != (F.col("p1") == "")) | (~anony & ~((F.col("p0") == F.col("h0")) & (F.col("p1") == F.col("h1")))) | (first["offset"] >= F.size(first["messages"]))
    named = [F.regexp_replace(F.when(anony, F.col(f"h{i}")).otherwise(F.col(f"p{i}")), "bard", "palm-2") for i in (0, 1)]
    win = F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), F.col("type"))
    return v.select(
        "vote_id", "tstamp", named[0].alias("model_a"), named[1].alias("model_b"), win.alias("win"), anony.alias("anony"),
        F.floor((F.size(first["messages"]) - first["offset"]) / 2).cast("int").alias("rounds"), F.when(invalid, "invalid").when(leaked, "leaked").alias("reason"),
    )


def clean_votes(log: DataFrame, legacy: bool = False) -> DataFrame:
    """L01. The votes that are kept."""
    return judged_votes(log, legacy).where("reason is null").drop("reason")


def reject_counts(log: DataFrame) -> DataFrame:
    """L01. Votes, invalid and leaked ones, kept ones and anonymous ones among them."""
    n = lambda c: F.count_if(c)
    return judged_votes(log).agg(
        F.count(F.lit(1)).alias("votes"), n(F.col("reason") == "invalid").alias("invalid"), n(F.col("reason") == "leaked").alias("leaked"),
        n(F.col("reason").isNull()).alias("battles"), n(F.col("reason").isNull() & F.col("anony")).alias("anony"),
    )


def elo_fold(a, b, win, **how) -> dict[str, float]:
    """Ratings after a sequence of votes."""
    return elo_steps(zip(a, b, win, strict=True), **how)


def elo_steps(votes: Iterable[tuple], k: float = 4.0, scale: float = 400.0, base: float = 10.0, start: float = 1000.0, rating: dict[str, float] | None = None) -> dict[str, float]:
    """The same of (a, b, win), one at a time; ``rating`` are the ratings before the first, which are changed in place."""
    rating = {} if rating is None else rating
    gain = {"model_a": 1.0, "model_b": 0.0, "tie": 0.5, "tie (bothbad)": 0.5}
    for x, y, w in votes:
        rx, ry = rating.get(x, start), rating.get(y, start)
        expected = 1 / (1 + base ** ((ry - rx) / scale))
        back = 1 / (1 + base ** ((rx - ry) / scale))
        rating[x] = rx + k * (gain[w] - expected)
        rating[y] = rating.get(y, start) + k * (1 - gain[w] - back)
    return rating


def elo(battles: DataFrame, board: str, order: list[str], before: DataFrame | None = None, **how) -> DataFrame:
    """L02. (board, model, rating): one sequential fold for each board, in the given order, from the ratings ``before`` (board, model,
    rating) on. Spark sorts, so a board may exceed a task's memory; the fold holds the ratings of its models."""
    keys = [f"_o{i}" for i in range(len(order))]
    rows = battles.select(F.col(board).cast("string").alias("_board"), F.lit(1).alias("_k"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], "model_a", "model_b", "win", F.lit(None).cast("double").alias("_r"))
    if before is not None:  # a board's ratings come first
        told = before.select(F.col("board").alias("_board"), F.lit(0).alias("_k"), F.col("model").alias("model_a"), F.col("rating").alias("_r"))
        rows = rows.unionByName(told, allowMissingColumns=True)
    rows = rows.repartition("_board").sortWithinPartitions("_board", "_k", *[F.col(k).asc_nulls_last() for k in keys])

    def votes_of(rows: Iterable[tuple], known: dict[str, float]) -> Iterator[tuple]:
        for _, k, a, b, win, r in rows:
            if k:
                yield a, b, win
            else:
                known[a] = r

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("_board", "_k", "model_a", "model_b", "win", "_r")
        rows = (v for batch in batches for v in zip(*[batch.column(n).to_pylist() for n in names], strict=True))
        for name, own in groupby(rows, key=lambda v: v[0]):
            known: dict[str, float] = {}
            r = elo_steps(votes_of(own, known), rating=known, **how)
            yield pa.RecordBatch.from_pydict(
                {"board": [name] * len(r), "model": list(r), "rating": list(r.values())},
                schema=pa.schema([("board", pa.string()), ("model", pa.string()), ("rating", pa.float64())]),
            )

    return rows.select("_board", "_k", "model_a", "model_b", "win", "_r").mapInArrow(fold, "board string, model string, rating double")


def elo_bootstrap(battles: DataFrame, rounds: int, seed: int = 0, k: float = 4.0, scale: float = 400.0, base: float = 10.0, start: float = 1000.0) -> DataFrame:
    """L03. (model, lower, rating, upper): the 2.5, 50 and 97.5 % points over resampled rounds. In each round a vote
    is drawn a Poisson(1) number of times by the md5 of (seed, round, vote); the votes are folded in md5 order. A round is a
    partition of its own, with one row for each drawn vote and how often it counts; Spark sorts it, and the fold holds the ratings of the models."""
    models = [r[0] for r in battles.select("model_a").union(battles.select("model_b")).distinct().collect()]
    spark = battles.sparkSession
    place = lambda side: F.broadcast(spark.createDataFrame(list(enumerate(models)), f"_{side} int, _name{side} string"))
    coded = battles.select("vote_id", "model_a", "model_b", F.when(F.col("win") == "model_a", 1.0).when(F.col("win") == "model_b", 0.0).otherwise(0.5).alias("_g"))
    for side in "ab":  # a row for each model
        coded = coded.join(place(side), F.col(f"model_{side}").eqNullSafe(F.col(f"_name{side}")))
    total, term, above = 0.0, 2.718281828459045 ** -1, []
    for i in range(8):
        total += term
        above.append(f"{min(int(total * (1 << 32)), (1 << 32) - 1):08x}g")  # the first eight digits are more than the others': g is after f
        term /= i + 1
    # as generated columns, the hashes are formed once
    one = lambda r: F.struct(r.alias("_round"), F.md5(F.concat_ws("|", F.lit(str(seed)), r, "vote_id")).alias("_h"))
    draws = F.filter(F.transform(F.sequence(F.lit(1), F.lit(rounds)), one), lambda x: x["_h"] > above[0])
    drawn = coded.select("_a", "_b", "_g", F.inline(draws))
    times = sum((F.col("_h") > c).cast("int") for c in above)
    rows = drawn.select("_round", F.unhex("_h").alias("_h"), "_a", "_b", "_g", times.alias("_n")).repartitionById(rounds, F.col("_round") - 1).sortWithinPartitions("_round", "_h")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rating, seen = [start] * len(models), set()
        for batch in batches:
            a, b, g, n = (batch.column(c) for c in ("_a", "_b", "_g", "_n"))
            seen.update(a.unique().to_pylist(), b.unique().to_pylist())
            for x, y, w, t in zip(a.to_pylist(), b.to_pylist(), g.to_pylist(), n.to_pylist(), strict=True):
                for _ in range(t):
                    rx, ry = rating[x], rating[y]
                    expected = 1 / (1 + base ** ((ry - rx) / scale))
                    back = 1 / (1 + base ** ((rx - ry) / scale))
                    rating[x] = rx + k * (w - expected)
                    rating[y] += k * (1 - w - back)
        yield pa.RecordBatch.from_pydict({"model": pa.array([models[i] for i in seen], pa.string()), "rating": pa.array([rating[i] for i in seen], pa.float64())})

    rated = rows.select("_a", "_b", "_g", "_n").mapInArrow(fold, "model string, rating double")
    points = [F.expr(f"percentile(rating, {p})").alias(n) for p, n in ((0.025, "lower"), (0.5, "rating"), (0.975, "upper"))]
    return rated.groupBy("model").agg(*points)


def win_fraction(battles: DataFrame) -> DataFrame:
    """L04. (model, other, fraction): share of the pair's battles that the model wins, from both orientations."""
    both = battles.select(F.col("model_a").alias("model"), F.col("model_b").alias("other"), (F.col("win") == "model_a").cast("double").alias("w")).unionByName(
        battles.select(F.col("model_b").alias("model"), F.col("model_a").alias("other"), (F.col("win") == "model_b").cast("double").alias("w"))
    )
    return both.groupBy("model", "other").agg(F.avg("w").alias("fraction"))


def win_matrix(battles: DataFrame, models: list[str]) -> DataFrame:
    """L04. The fractions as a matrix: a row for each model in the order of its mean fraction, best first, and a column for
    each of ``models``; null where two have not met."""
    long = win_fraction(battles)
    wide = long.groupBy("model").pivot("other", models).agg(F.first("fraction"))
    w = Window.orderBy(F.desc("_mean"), "model")  # one row for each model
    means = long.groupBy("model").agg(F.avg("fraction").alias("_mean"))
    return wide.join(means.select("model", F.row_number().over(w).alias("place")), "model").select("place", "model", *quoted(models))


def average_win_rate(battles: DataFrame) -> DataFrame:
    """L04. Mean fraction of each model over its opponents."""
    return win_fraction(battles).groupBy("model").agg(F.avg("fraction").alias("rate"))


def battle_counts(battles: DataFrame, models: list[str]) -> DataFrame:
    """L05. Symmetric pair counts, one column for each model."""
    both = battles.select("model_a", "model_b").unionByName(battles.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b")))
    return both.groupBy("model_a").pivot("model_b", models).count().na.fill(0)


def leaderboard(ratings: DataFrame, info: DataFrame) -> DataFrame:
    """L06. Rank by rating with the models' descriptions."""
    w = Window.orderBy(F.desc("rating"), "model")  # one row for each model
    return ratings.withColumn("rank", F.row_number().over(w)).join(info, "model", "left").select("rank", "model", F.round("rating").alias("rating"), "description")


def recency(log: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """L07. Rows by key in all, the last day and the last hour before the newest row. ``inner`` drops keys that the
    last hour has not."""
    newest = log.agg(F.max("tstamp").alias("now"))
    n = log.crossJoin(F.broadcast(newest)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("tstamp") > F.col("now") - 86400).alias("last_day"), F.count_if(F.col("tstamp") > F.col("now") - 3600).alias("last_hour")
    )
    return n.where("last_day > 0 and last_hour > 0") if how == "inner" else n


def anonymous_votes(log: DataFrame) -> DataFrame:
    """L08."""
    return log.where(F.col("type").isin(list(OUTCOMES)) & (F.col("models")[0] == ""))


def daily_counts(log: DataFrame, kind: str = "type", timezone: str = TIMEZONE) -> DataFrame:
    """L09. Rows by local day and kind."""
    day = F.to_date(local_time("tstamp", timezone))
    return log.groupBy(day.alias("day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def hourly_buckets(log: DataFrame, kind: str, hours: int = 24) -> DataFrame:
    """L10. (bucket, n): rows of a kind in half-open hours from the first row of the last day; empty hours are 0."""
    newest = log.agg(F.max("tstamp").alias("now"))
    day = log.crossJoin(F.broadcast(newest)).where("tstamp > now - 86400").select("tstamp", "type")
    base = day.agg(F.min("tstamp").alias("base"))
    n = day.where(F.col("type") == kind).crossJoin(F.broadcast(base)).groupBy(F.floor((F.col("tstamp") - F.col("base")) / 3600).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    all_hours = log.sparkSession.range(hours).select(F.col("id").cast("int").alias("bucket"))
    return all_hours.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
