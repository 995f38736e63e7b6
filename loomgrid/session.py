"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("loomgrid")
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or where that is unset and all runs in one process (tests) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = getattr(spark, "_loomgrid_dir", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
            spark._loomgrid_dir = folder
            atexit.register(_remove, spark, folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder then belongs to whoever set it
        pass


def stage(df: DataFrame, name: str = "stage", once: bool = False) -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it back.

    Cuts lineage durably: the files outlive any executor, and unlike a persisted frame they
    are columnar, compressed and carry sizes from which the planner picks join strategies.
    The table stays until ``release`` or the end of the session. ``once``: the shuffle files of the writing are
    removed as soon as it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgrid-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if once:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if once:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgrid_path = path
    return out


def release(*staged: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in staged:
        _remove(df.sparkSession, df._loomgrid_path)
