"""Cutting lineage through the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """cut() ends a DataFrame's lineage with a checkpoint in ``spark.checkpoint.dir``; where
    that is unset and the master is local (as in tests) a temporary folder becomes it."""

    def __init__(self, spark: SparkSession):
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foldline-"))

    def cut(self, df: DataFrame) -> DataFrame:
        return df.checkpoint()

    @contextmanager
    def table(self, df: DataFrame) -> Iterator[DataFrame]:
        """df, evaluated once and kept as Parquet for as long as the block runs: for what is
        read several times and costs more to make than to read."""
        spark = df.sparkSession
        path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
        try:
            with small_files(spark):
                df.write.option("compression", "zstd").parquet(path)
            yield spark.read.schema(df.schema).parquet(path)
        finally:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark counts a file as 4 MB at least, so a task would read 32 files, few for what a task costs.
SMALL = {"spark.sql.files.openCostInBytes": str(128 << 10), "spark.sql.files.maxPartitionBytes": str(32 << 20)}


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Actions in the block read up to 256 files in a task, but no more than 32 MB (or one file)."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
