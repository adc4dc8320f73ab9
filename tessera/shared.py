"""The folder that the driver and all executors share, and tables written there to end a lineage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a
    temporary one; on a cluster that is an error, as each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tessera-shared-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _root(spark: SparkSession) -> str:
    """The folder of this application in the shared one; it goes when the driver's process ends."""
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        atexit.register(_delete, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return root


def _delete(files, path) -> None:
    try:
        files.delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM or the folder may be gone when the process ends
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor
    costs nothing, as the files are not on it. The table stays until `discard` or the end of the driver.

    Values of megabytes that are compressed already go with compression `none`: the codec's buffers, outside the heap, are as
    large as the largest page and stay with each thread."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of `materialize` that no plan will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.tessera_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let the driver collect its garbage: files of shuffles that no plan holds any more stay on the executors' disks until it
    does. After a materialized stage that shuffled about as much as the input."""
    gc.collect()
    spark._jvm.System.gc()
