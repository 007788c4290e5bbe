"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/quillfold-checkpoints"
    return folder


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Kept:
    """Tables written to a sub-folder of the shared folder and read from there: lineage ends, no work is done twice, and any
    executor may be lost. discard() deletes them, once nothing reads them any more."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def discard(self) -> None:
        discard(self.spark, self.path)
