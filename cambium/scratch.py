"""Tables that cut lineage, kept where every executor and the driver can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
#: Spark's setting by which a query's shuffle files go at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A folder of our own only where the setting is unset and all runs on one machine, as in tests."""
    global _own
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="cambium-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def posix_dir(spark: SparkSession, name: str) -> str | None:
    """A folder in the shared one as a path that files can be mapped from; None where the shared one isn't a mounted file system. It goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if "://" in path and not path.startswith("file:///") or path.startswith("file:") and not path.startswith("file:/"):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        return None
    system.mkdirs(place)
    system.deleteOnExit(place)
    return "/" + path.removeprefix("file:").lstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: a lost executor then costs a read, not the work before. It goes when the application ends,
    and the shuffle files that it was made from go once it is there, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
