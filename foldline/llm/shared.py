"""Files and tables that the driver and every executor can see."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset and all runs in one
    process (a local master, as in tests), a temporary folder which then becomes the
    checkpoint folder.  On a cluster it must be set: a folder of one machine is no use there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foldline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S110  the session has ended; the folder is the cluster's scratch
            pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/foldline/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: the lineage ends there,
    so a lost executor costs a read and no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffles' files go once the table is written, not when the driver collects its garbage
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete table()s that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._scratch)
