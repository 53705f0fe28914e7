"""Readers and writers of the file formats that text graphs come in. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from loomgraph.functions.storage import folders


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, line_ends: bool = False) -> DataFrame:
    """S01, S02, S03. Quoted fields may hold separators, and with ``line_ends`` line ends; then a file is one task. Without, plain files
    are split; .gz files cannot be, so the rows are dealt out again by the caller."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep, quote='"', escape='"', multiLine=line_ends)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S04. One JSON document for each file, over several lines; a task reads whole files, so large ones do not split."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """S05. One object for each line; missing fields get their default."""
    df = spark.read.schema(schema).json(path)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(name, F.lit(value)))
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    """S06."""
    df.write.mode("overwrite").json(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """S07. (split, h, r, t) from lines of three fields; the split is the name of the file's folder or file."""
    parts = F.split(F.trim("value"), r"\s+")
    split = F.regexp_extract(F.input_file_name(), r"split=([^/]+)/", 1)
    return spark.read.text(path).where(F.trim("value") != "").select(split.alias("split"), *[parts[i].alias(c) for i, c in enumerate("hrt")])


def clean_utf8(df: DataFrame, *cols: str) -> DataFrame:
    """S08. Replacement characters of undecodable bytes are dropped."""
    return df.withColumns({c: F.regexp_replace(c, "�", "") for c in cols})


def dated_logs(spark: SparkSession, path: str, schema: str, last: int) -> DataFrame:
    """S09. The newest ``last`` days of logs laid out as date=.../server=...: the days are the names of the folders, and
    only theirs are listed further and read."""
    days = sorted(n for n in folders(spark, path) if n.startswith("date="))[-last:]
    kind = schema + ", date string, server int"
    if not days:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("basePath", path).json([f"{path}/{n}" for n in days])


def read_split_lists(df: DataFrame, column: str) -> DataFrame:
    """S10. (split, position, class) from a JSON array of arrays of class ids, one array for each split."""
    outer = df.select(F.posexplode(F.from_json(column, "array<array<int>>")).alias("split", "classes"))
    return outer.select("split", F.posexplode("classes").alias("position", "class"))


def load_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """S11. The table at ``path``; computed and written first if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def narrow_types(df: DataFrame) -> DataFrame:
    """S12. Integer columns in the narrowest type that holds them, by one aggregate over all."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, (LongType, IntegerType, ShortType))]
    if not whole:
        return df
    ends = df.agg(*[x for c in whole for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    out = {}
    for c in whole:
        lo, hi = ends[f"lo_{c}"] or 0, ends[f"hi_{c}"] or 0
        for kind, bits in ((ByteType(), 8), (ShortType(), 16), (IntegerType(), 32)):
            if -(1 << bits - 1) <= lo and hi < 1 << bits - 1:
                out[c] = F.col(c).cast(kind)
                break
    return df.withColumns(out)


def write_graph_parts(nodes: DataFrame, path: str, excluded: list[int], parts: int) -> None:
    """S13. Nodes by hash part; excluded and missing labels are -1."""
    label = F.when(F.col("label").isNull() | F.col("label").isin(excluded), -1).otherwise(F.col("label"))
    nodes.withColumn("label", label).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("overwrite").partitionBy("part").parquet(path)


def write_results(df: DataFrame, path: str) -> DataFrame:
    """S14. Complete rows with a flag whether the answer holds the truth, wrong ones first, as CSV; returns the rates."""
    done = df.dropna().withColumn("correct", F.contains(F.lower("answer"), F.lower("truth")))
    done.orderBy("correct", "id").write.mode("overwrite").csv(path, header=True)
    return done.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("rate"))
