"""Tables written to the folder that all executors share.

A stage that is read more than once, or whose lineage would grow in a loop, is written as Parquet under
``spark.checkpoint.dir`` and read again. A lost executor then costs a re-read, not a re-computation. All tables of an
application lie in one folder, which :func:`clean` deletes when its results are no longer read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary one; on a
    cluster that is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/loom-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_delete = delete  # as loomgraph.llm imports it


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back with its schema: no lineage, any number of reads."""
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path, out._stash_table = path, None
    return out


def stash_bucketed(df: DataFrame, keys: list[str], name: str = "table", buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Like :func:`stash`, dealt into buckets by ``keys`` and sorted by them in each: joins on the keys do not
    shuffle it again. ``path`` may name a folder that outlives the application."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = uuid.uuid4().hex
    path, table = path or f"{_home(spark)}/{name}-{number}", f"loom_{name}_{number}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(table)
    return _named(spark, path, table)


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """A table that :func:`stash_bucketed` has written to ``path``, perhaps in another application."""
    table, by = f"loom_open_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return _named(spark, path, table)


def _named(spark: SparkSession, path: str, table: str) -> DataFrame:
    out = spark.table(table)
    out._stash_path, out._stash_table = path, table
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more: their results are written elsewhere."""
    for df in stashed:
        if df._stash_table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._stash_table}")
        delete(df.sparkSession, df._stash_path)


def clean(spark: SparkSession) -> None:
    """Delete every table that this application has stashed. Results that were not written elsewhere are lost."""
    delete(spark, _home(spark))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none where it does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a dataset folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
