"""Live statistics and ratings: several batches, a repeated batch and a restart against the batch operators."""

from pyspark.sql import functions as F

from loomgraph.functions.storage import folders
from loomgraph.operators import logs as L
from loomgraph.streaming import usage as W


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_live_counts_over_restarts(spark, tmp_path):
    rows = [(float(t), k) for t, k in [(1_000, "a"), (90_000, "a"), (95_000, "b"), (2_000, "late"), (181_000, "a"), (181_000, "a"), (180_000, "b"), (100_000, "c"), (178_000, "c")]]
    schema, path, place = "tstamp double, type string", str(tmp_path / "in"), "file://" + str(tmp_path / "out")
    for k in (0, 3, 6):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(path)
        got = W.live_counts(stream(spark, schema, path), place, timezone="UTC")
    whole = spark.createDataFrame(rows, schema)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(W.live_recency(got, "left"), L.recency(whole, "type", "left")) and same(W.live_recency(got), L.recency(whole, "type"))
    assert same(W.live_days(got), L.daily_counts(whole, timezone="UTC")) and same(W.live_hours(got, "a"), L.hourly_buckets(whole, "a"))
    # only the last day's instants are state
    assert {r.at for r in got.where("level = 'last'").collect()} == {181_000.0, 180_000.0, 100_000.0, 178_000.0, 95_000.0}
    assert len(folders(spark, place + "/out")) <= 3


def test_live_ratings_and_a_repeated_batch(spark, tmp_path):
    names = ["x", "y", "z"]
    votes = [(float(i), i, names[i % 3], names[(i * 5 + 1) % 3], ("model_a", "model_b", "tie")[i * 7 % 3], str(i % 2)) for i in range(60)]
    votes.append((99.0, 99, "x", "new", "model_b", "late board"))
    schema = "tstamp double, vote_id long, model_a string, model_b string, win string, board string"
    path, place = str(tmp_path / "in"), "file://" + str(tmp_path / "out")
    df = spark.createDataFrame(votes, schema)
    for a, b in ((0, 20), (20, 45), (45, 100)):
        df.where((F.col("vote_id") >= a) & (F.col("vote_id") < b)).coalesce(1).write.mode("append").parquet(path)
        got = W.live_ratings(stream(spark, schema, path), place)
    want = sorted(map(tuple, L.elo(df, "board", ["tstamp", "vote_id"]).collect()))
    assert sorted(map(tuple, got.collect())) == want
    # the last batch again, as after a failure: it starts from the state before it
    last = df.where("vote_id >= 45")
    before = W.version(spark, place + "/out", W.RATINGS, 2)
    assert sorted(map(tuple, L.elo(last, "board", ["tstamp", "vote_id"], before).collect())) == want
