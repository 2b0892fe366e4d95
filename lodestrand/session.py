"""Session helpers: building a session, and durable cuts of the lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def get_spark(app: str = "lodestrand", master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; on a cluster, pass the session that exists there instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LODESTRAND_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and the master is local is a temporary folder made instead.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="lodestrand-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def deleted_at_exit(spark: SparkSession, path: str) -> str:
    """Has the driver's file system delete the folder, which is made if it isn't there, when the application ends. What a lost driver leaves behind bears the application's id."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def fresh_dir(spark: SparkSession) -> str:
    """A path in the shared folder at which nothing is yet, within a folder that is deleted at exit."""
    return deleted_at_exit(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}") + "/data"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages, and retries after a
    lost executor, start from the files and not from the beginning."""
    spark = df.sparkSession
    path = fresh_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
