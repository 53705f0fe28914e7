"""Live statistics on a growing log as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import local_time
from loomgraph.functions.storage import delete, folders
from loomgraph.operators.logs import TIMEZONE, clean_votes, elo

DAY = 86_400
COUNTS = "level string, kind string, at double, n long"
RATINGS = "board string, model string, rating double"


def usage_windows(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """W01. (start, kind, n): counts in tumbling windows. On a stream, rows later than ``late`` are dropped."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def live_votes(log: DataFrame, late: str = "1 day") -> DataFrame:
    """W02. Clean votes, each once; on a stream, repeats are known as long as the watermark keeps them."""
    timed = log.withColumn("at", F.timestamp_micros((F.col("tstamp") * 1e6).cast("long")))
    once = timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["vote_id"]) if log.isStreaming else timed.dropDuplicates(["vote_id"])
    return clean_votes(once)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there, to Parquet under ``path`` with its checkpoint, and read the result. Started again, it goes
    on after the last committed file."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def counts_available(stream: DataFrame, path: str) -> DataFrame:
    """The final counts of a windowed stream: every batch's updates, the last of each window."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.parquet(f"{path}/out").groupBy("start", "kind").agg(F.max_by("n", "batch").alias("n"))


def version(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest state under ``path``, or the newest that a batch with a smaller number than ``before`` has left; empty at first."""
    numbers = [int(n.partition("=")[2]) for n in folders(spark, path) if n.startswith("batch=")]
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.schema(schema).parquet(f"{path}/batch={max(numbers)}") if numbers else spark.createDataFrame([], schema)


def carried(stream: DataFrame, path: str, schema: str, step, kept: int = 3) -> None:
    """Runs the stream over what is there. Each micro-batch writes the state ``step(state before, batch)`` under its own number, so a
    batch that is repeated after a failure starts from the same state and overwrites its own; the last ``kept`` states stay."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        step(version(spark, f"{path}/out", schema, number), batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        for name in folders(spark, f"{path}/out"):
            if name.startswith("batch=") and int(name[6:]) <= number - kept:
                delete(spark, f"{path}/out/{name}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def counted(before: DataFrame, log: DataFrame, kind: str = "type", timezone: str = TIMEZONE) -> DataFrame:
    """One step of the live statistics: counts (level, kind, at, n) of each kind in all, by local day, and by instant of the last day
    before the newest row. Instants that fall out of that day are evicted; rows that are later than a day still count in all and
    for their day. Rows are counted before the shuffle, so a frequent kind is no hot key."""
    at = F.col("tstamp").cast("double")
    day = F.unix_date(F.to_date(local_time("tstamp", timezone))).cast("double")
    rows = log.where("tstamp is not null").select(F.col(kind).cast("string").alias("kind"), F.explode(F.array(
        F.struct(F.lit("all").alias("level"), F.lit(None).cast("double").alias("at")), F.struct(F.lit("day").alias("level"), day.alias("at")),
        F.struct(F.lit("last").alias("level"), at.alias("at")))).alias("c"))
    new = rows.groupBy("c.level", "kind", "c.at").agg(F.count(F.lit(1)).alias("n"))
    every = before.unionByName(new).groupBy("level", "kind", "at").agg(F.sum("n").alias("n"))
    now = every.where("level = 'last'").agg(F.max("at").alias("now"))
    return every.crossJoin(F.broadcast(now)).where((F.col("level") != "last") | (F.col("at") > F.col("now") - DAY)).drop("now")


def live_counts(log: DataFrame, path: str, kind: str = "type", timezone: str = TIMEZONE) -> DataFrame:
    """W01. The counts of :func:`counted` after all that the stream has, started again from the last state."""
    carried(log, path, COUNTS, lambda before, batch: counted(before, batch, kind, timezone))
    return version(log.sparkSession, f"{path}/out", COUNTS)


def live_recency(counts: DataFrame, how: str = "inner") -> DataFrame:
    """W01. (kind, n_all, last_day, last_hour) as L07."""
    now = counts.where("level = 'last'").agg(F.max("at").alias("now"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    last = F.col("level") == "last"
    out = counts.crossJoin(F.broadcast(now)).groupBy("kind").agg(
        n(F.col("level") == "all").alias("n_all"), n(last).alias("last_day"), n(last & (F.col("at") > F.col("now") - 3_600)).alias("last_hour"))
    return out.where("last_day > 0 and last_hour > 0") if how == "inner" else out


def live_days(counts: DataFrame) -> DataFrame:
    """W01. (day, kind, n) as L09."""
    return counts.where("level = 'day'").select(F.date_from_unix_date(F.col("at").cast("int")).alias("day"), "kind", "n")


def live_hours(counts: DataFrame, kind: str, hours: int = 24) -> DataFrame:
    """W01. (bucket, n) as L10."""
    last = counts.where("level = 'last'")
    base = last.agg(F.min("at").alias("base"))
    n = last.where(F.col("kind") == kind).crossJoin(F.broadcast(base)).groupBy(F.floor((F.col("at") - F.col("base")) / 3600).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    return counts.sparkSession.range(hours).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def live_ratings(votes: DataFrame, path: str, board: str = "board", order: tuple[str, ...] = ("tstamp", "vote_id"), **how) -> DataFrame:
    """W02. (board, model, rating): the fold of L02 carried on by each micro-batch from the stored ratings. Votes are folded in the given
    order inside a batch; batches are taken as they come."""
    carried(votes, path, RATINGS, lambda before, batch: elo(batch, board, list(order), before, **how))
    return version(votes.sparkSession, f"{path}/out", RATINGS)
