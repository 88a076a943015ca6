"""Streams of events: windowed counts, duplicates and sessions with a watermark, running weighted moments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count and mean value of each type per window. In append and update mode rows later than the watermark are left out; complete mode keeps every window."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first row of each key; state of a key goes once the watermark has passed it, rows later than the watermark are left out."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """key, start, stop (of the last row), n of each run of rows of a key that are less than ``gap`` apart."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.max("ts").alias("stop"))
    return g.select(key, F.col("w.start").alias("start"), "stop", "n")


def running_moments(events: DataFrame, key: str = "user_id", value: str = "value", error: str = "error") -> DataFrame:
    """key, n, weighted mean and weighted variance of all rows so far: four sums a key are the state, whatever the number of rows (complete and update mode)."""
    w = F.when(F.col(value).isNotNull() & (F.col(error) > 0), 1 / (F.col(error) * F.col(error)))
    sums = events.groupBy(key).agg(F.count(w).alias("n"), F.sum(w).alias("w"), F.sum(w * F.col(value)).alias("wx"), F.sum(w * F.col(value) * F.col(value)).alias("wxx"))
    mean = F.try_divide("wx", "w")
    return sums.select(key, "n", mean.alias("mean"), F.greatest(F.lit(0.0), F.try_divide("wxx", "w") - mean * mean).alias("variance"))


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the stream, exactly once; ``folder`` holds progress and output and may be used again when more has come.

    Each batch writes a part of its own number, so a batch that is run again replaces itself. In complete mode the last part
    is the result, in append mode all are.
    """
    out, done = f"{folder}/out", []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        done.append(batch)

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").foreachBatch(write).start().awaitTermination()
    try:
        parts = stream.sparkSession.read.schema(StructType(stream.schema.fields).add("batch", "long")).option("basePath", out).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return stream.sparkSession.createDataFrame([], stream.schema)  # no batch yet
    if mode == "complete":
        parts = parts.where(F.col("batch") == (done[-1] if done else parts.agg(F.max("batch")).first()[0]))
    return parts.drop("batch")
