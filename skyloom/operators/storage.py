"""Intermediate results in the folder that driver and executors share, and broadcasts of measured size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may hold this many bytes at most; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Only where all runs in one process may it be unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="skyloom-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def durable(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: later steps don't recompute it when an executor is lost."""
    path = f"{folder or shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Durable frames of one phase, whose files go together once nothing will read them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, new_folder(spark)

    def __call__(self, df: DataFrame) -> DataFrame:
        return durable(df, self.folder)

    def free(self) -> None:
        """Replaces all of it by one empty file."""
        self.spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(self.folder)


def small(df: DataFrame, bytes_per_row: int | Column) -> DataFrame:
    """``df`` marked for broadcast if its measured size stays below BROADCAST_BYTES, else as it is (the join then shuffles)."""
    size = df.count() * bytes_per_row if isinstance(bytes_per_row, int) else df.agg(F.sum(bytes_per_row)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
