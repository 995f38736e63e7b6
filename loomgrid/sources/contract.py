"""The mining contract: schema, JSON reader that keeps bad files apart, factor rows, and resumable sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTOR = T.StructType(
    [
        T.StructField("factor_id", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("type", "name", "expression", "grammar", "language", "source", "entry_point")],
        T.StructField("weight", T.DoubleType()),
        T.StructField("train_metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
CONTRACT = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("schema_version", "method", "paradigm", "output_form", "market")],
        T.StructField("seed", T.LongType()),
        T.StructField("split", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("target", T.StringType()),
        T.StructField("search_budget", T.MapType(T.StringType(), T.StringType())),
        T.StructField("wall_clock_seconds", T.DoubleType()),
        T.StructField("provenance", T.StructType([T.StructField(n, T.StringType()) for n in ("repo", "commit", "entry", "notes")])),
        T.StructField("factors", T.ArrayType(FACTOR)),
    ]
)


def read_contracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON contracts under a glob: the readable ones with their ``run`` (the folder's name), and the unreadable ones' files."""
    schema = T.StructType([*CONTRACT.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    good = F.col("_corrupt_record").isNull() & F.col("method").isNotNull()
    run = F.element_at(F.split("file", "/"), -2)
    return rows.where(good).drop("_corrupt_record").withColumn("run", run), rows.where(~good).select("file", "_corrupt_record")


def write_contracts(runs: DataFrame, path: str) -> None:
    """Contracts as JSON, one folder per run; a null metric stays null."""
    runs.write.mode("overwrite").partitionBy("run").option("ignoreNullFields", False).json(path)


def factor_rows(runs: DataFrame) -> DataFrame:
    """One row per run and factor of the latest delivery of each shard; a factor in several shards comes from the first."""
    latest = Window.partitionBy("run", "shard_no").orderBy(F.desc("delivered_at"))
    shards = runs.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1")
    rows = shards.select("run", "method", "market", "seed", "split", "shard_no", F.explode("factors").alias("f")).select("run", "method", "market", "seed", "split", "shard_no", "f.*")
    first = Window.partitionBy("run", "factor_id").orderBy("shard_no")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "shard_no")


def append_missing(new: DataFrame, path: str, keys: list[str], retry_failed: bool = False) -> int:
    """Appends the rows whose keys are not in the parquet table at ``path``; with ``retry_failed``, those whose status there is not ok count as missing.

    Returns the number of appended rows. Failed rows of earlier runs stay; readers take the latest per key.
    """
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        done = spark.read.parquet(path)
        if retry_failed:
            done = done.where("status = 'ok'")
        new = new.join(done.select(*keys).distinct(), keys, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def save_with_fingerprint(df: DataFrame, path: str, fingerprint: str) -> None:
    """A signal table or correlation edge list with the fingerprint of what it was made from."""
    df.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)


def load_with_fingerprint(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """The saved table if it was made from the same inputs, else None."""
    df = spark.read.parquet(path)
    if df.where(F.col("fingerprint") != fingerprint).limit(1).count():
        return None
    return df.drop("fingerprint")
