"""The domain's tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Filter number of each event type; 5 is the reference band.
BANDS = {"view": 5, "click": 4, "purchase": 3, "signup": 2, "error": 1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light curves in long form, one row per detection."""
    e = table(spark, sf_dir, "events")
    band = F.lit(None).cast("int")
    for name, number in BANDS.items():
        band = F.when(F.col("event_type") == name, number).otherwise(band)
    return e.select(
        "event_id",
        F.col("user_id").alias("sourceid"),
        (F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / F.lit(86400e6)).alias("t"),
        F.col("value").alias("mag"),
        (0.05 + 0.001 * F.col("value")).alias("emag"),
        band.alias("filterid"),
        (F.get_json_object("props", "$.k").cast("double") / 10).alias("chi"),
        (F.col("event_id") % 13).cast("double").alias("ast_res_chisq"),
        (F.col("event_id") % 17 == 0).alias("ambiguous_match"),
    )


DETECTIONS = """lc AS (
    SELECT event_id, user_id AS sourceid, (epoch_us(ts) - 1704067200000000) / 86400e6 AS t, value AS mag, 0.05 + 0.001 * value AS emag,
           CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'error' THEN 1 END AS filterid,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS chi, CAST(event_id % 13 AS DOUBLE) AS ast_res_chisq, event_id % 17 = 0 AS ambiguous_match
    FROM events)"""


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with positions in degrees and a magnitude."""
    e = table(spark, sf_dir, "embeddings")
    x, y, z = (F.col("embedding")[k].cast("double") for k in range(3))
    r = F.sqrt(x * x + y * y + z * z)
    return e.select(
        F.col("vec_id").alias("sourceid"),
        F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)).alias("lon"),
        F.degrees(F.asin(z / r)).alias("lat"),
        F.col("embedding")[3].cast("double").alias("mag"),
        "label",
    )


SKY = """sky AS (
    SELECT vec_id AS sourceid, fmod(degrees(atan2(y, x)) + 360, 360) AS lon, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS lat, mag, label
    FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS mag FROM embeddings))"""
