"""Queries of the vote-log and usage analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.columns import epoch_seconds
from loomgraph.functions.storage import table
from loomgraph.operators import logs as L
from loomgraph.plans import fixtures as X
from loomgraph.plans.fixtures import sql

BOOK = X.Book()
add = BOOK.add
MODELS = [f"model-{i}" for i in (0, 1, 2, 3, 4, 6)] + ["palm-2-5"]


def battles(s, d):
    return L.clean_votes(X.vote_log(s, d))


def usage(s, d):
    return table(s, d, "events").select("event_id", epoch_seconds("ts").alias("tstamp"), F.col("event_type").alias("type"), (F.col("user_id") % 7).alias("model"))


USAGE = "SELECT event_id, epoch_us(ts) / 1e6 AS tstamp, event_type AS type, user_id % 7 AS model FROM events"
# a rating's vote: the ratings so far are a list by the models' places in MODELS, null for a model without a vote
_PLACE = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"


def _fold(board, votes, order):
    """CTEs o (the votes of each board in order) and e (the ratings after each)."""
    expected = "1 / (1 + 10.0::DOUBLE ** ((coalesce(r[{y}], 1000) - coalesce(r[{x}], 1000)) / 400))"
    return {
        "o": f"SELECT {board} AS board, list_position({_PLACE}, model_a) AS a, list_position({_PLACE}, model_b) AS b, CASE win WHEN 'model_a' THEN 1.0 WHEN 'model_b' THEN 0.0 ELSE 0.5 END::DOUBLE AS gain, row_number() OVER (PARTITION BY {board} ORDER BY {order}) AS pos FROM {votes}",
        "e": "SELECT DISTINCT board, 0::BIGINT AS pos, [" + ", ".join(["NULL::DOUBLE"] * len(MODELS)) + "] AS r FROM o UNION ALL SELECT o.board, o.pos, list_transform(e.r, lambda x, i: CASE WHEN i = o.a AND i = o.b THEN coalesce(x, 1000) WHEN i = o.a THEN coalesce(x, 1000) + 4 * (gain - "
        + expected.format(x="o.a", y="o.b") + ") WHEN i = o.b THEN coalesce(x, 1000) + 4 * (1 - gain - " + expected.format(x="o.b", y="o.a") + ") ELSE x END) FROM e JOIN o ON o.board = e.board AND o.pos = e.pos + 1",
    }


add("l01_clean_votes", battles, sql("SELECT * FROM battles", "battles"))
add("l01_reject_counts", lambda s, d: L.reject_counts(X.vote_log(s, d)),
    sql("SELECT count(*) AS votes, count(*) FILTER (reason = 'invalid') AS invalid, count(*) FILTER (reason = 'leaked') AS leaked, count(*) FILTER (reason IS NULL) AS battles, count(*) FILTER (reason IS NULL AND anony) AS anony FROM judged", "judged"))
add("l02_elo", lambda s, d: L.elo(battles(s, d).withColumn("board", (F.col("vote_id") % 4).cast("string")), "board", ["tstamp", "vote_id"]).withColumn("rating", F.round("rating", 6)),
    sql("SELECT board, m AS model, round(x, 6) AS rating FROM (SELECT board, unnest([" + ", ".join(f"'{m}'" for m in MODELS) + "]) AS m, unnest(r) AS x FROM e WHERE pos = (SELECT max(pos) FROM o WHERE o.board = e.board)) WHERE x IS NOT NULL", "battles", recursive=True, **_fold("(vote_id % 4)::VARCHAR", "battles", "tstamp, vote_id")))
add("l03_elo_bootstrap", lambda s, d: L.elo_bootstrap(battles(s, d), 200).select("model", *[F.round(c, 4).alias(c) for c in ("lower", "rating", "upper")]))
_WIN = "SELECT model, other, avg(w) AS fraction FROM (SELECT model_a AS model, model_b AS other, (win = 'model_a')::INT AS w FROM battles UNION ALL SELECT model_b, model_a, (win = 'model_b')::INT FROM battles) GROUP BY 1, 2"
add("l04_win_fraction", lambda s, d: L.win_fraction(battles(s, d)).withColumn("fraction", F.round("fraction", 6)), sql("SELECT model, other, round(fraction, 6) AS fraction FROM w", "battles", w=_WIN))
add("l04_win_matrix", lambda s, d: L.win_matrix(battles(s, d), MODELS).select("place", "model", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in MODELS]),
    sql("SELECT place::INT AS place, model, " + ", ".join(f"round(max(fraction) FILTER (other = '{m}'), 6) AS \"{m}\"" for m in MODELS) + " FROM w JOIN (SELECT model, row_number() OVER (ORDER BY avg(fraction) DESC, model) AS place FROM w GROUP BY 1) USING (model) GROUP BY 1, 2", "battles", w=_WIN))
add("l04_average_win_rate", lambda s, d: L.average_win_rate(battles(s, d)).withColumn("rate", F.round("rate", 6)), sql("SELECT model, round(avg(fraction), 6) AS rate FROM w GROUP BY 1", "battles", w=_WIN))
add("l05_battle_counts", lambda s, d: L.battle_counts(battles(s, d), MODELS),
    sql("SELECT model_a, " + ", ".join(f"count(*) FILTER (model_b = '{m}') AS \"{m}\"" for m in MODELS) + " FROM (SELECT model_a, model_b FROM battles UNION ALL SELECT model_b, model_a FROM battles) GROUP BY 1", "battles"))
add("l06_leaderboard", lambda s, d: L.leaderboard(L.average_win_rate(battles(s, d)).select("model", (F.round(F.col("rate"), 6) * 1000).alias("rating")), table(s, d, "nation").select(F.concat(F.lit("model-"), "n_nationkey").alias("model"), F.col("n_name").alias("description"))),
    sql("SELECT row_number() OVER (ORDER BY r DESC, model)::INT AS rank, model, round(r) AS rating, n_name AS description FROM (SELECT model, round(avg(fraction), 6) * 1000 AS r FROM w GROUP BY 1) LEFT JOIN nation ON model = 'model-' || n_nationkey", "battles", w=_WIN))
for _key in ("type", "model"):
    add(f"l07_recency_by_{_key}", lambda s, d, k=_key: L.recency(usage(s, d), k),
        sql(f"SELECT {_key}, count(*) AS n_all, count(*) FILTER (tstamp > now - 86400) AS last_day, count(*) FILTER (tstamp > now - 3600) AS last_hour FROM u, (SELECT max(tstamp) AS now FROM u) GROUP BY 1 HAVING last_day > 0 AND last_hour > 0", u=USAGE))
add("l08_anonymous_votes", lambda s, d: L.anonymous_votes(X.vote_log(s, d)).select("vote_id", "type"), sql("SELECT vote_id, type FROM votes WHERE type <> 'chat' AND (vote_id % 3 = 0 OR vote_id % 11 = 0)", "votes"))
add("l09_daily_counts", lambda s, d: L.daily_counts(usage(s, d), timezone="America/Bogota").withColumn("day", F.col("day").cast("string")),
    sql("SELECT ((to_timestamp(tstamp) AT TIME ZONE 'UTC') - INTERVAL 5 HOUR)::DATE::VARCHAR AS day, type AS kind, count(*) AS n FROM u GROUP BY 1, 2", u=USAGE))
add("l10_hourly_buckets", lambda s, d: L.hourly_buckets(usage(s, d), "click"),
    sql("SELECT b::INT AS bucket, count(tstamp) AS n FROM range(24) r(b) LEFT JOIN (SELECT tstamp, floor((tstamp - min(tstamp) OVER ()) / 3600) AS h, type FROM u, (SELECT max(tstamp) AS now FROM u) WHERE tstamp > now - 86400) ON h = b AND type = 'click' GROUP BY 1", u=USAGE))
add("t17_html_label_strip", lambda s, d: X.vote_log(s, d).select("vote_id", L.strip_html(F.col("models")[0]).alias("name")),
    sql("SELECT vote_id, CASE WHEN vote_id % 3 = 0 OR vote_id % 11 = 0 THEN '' ELSE m0 END AS name FROM votes", "votes"))
