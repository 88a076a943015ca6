"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.operators.storage import BROADCAST_BYTES, Scratch, durable, shared_dir, small

__all__ = ["BROADCAST_BYTES", "Scratch", "bound_batches", "durable", "shared_dir", "small", "table"]


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows at most in this session from now on: texts are long, and a batch is held whole by the executor and by its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
