"""Readers and writers: tolerant CSV, logs, appends in chunks, sinks that can be run again, and JDBC."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """CSV with a declared schema (plain or gzip, one file or a pattern); malformed lines are left out, ``file`` names each row's file."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, mode="DROPMALFORMED").withColumn("file", F.input_file_name())


def write_routed(df: DataFrame, path: str, route: Column, name: str = "bucket") -> None:
    """One folder for each value of ``route``."""
    df.withColumn(name, route).repartition(name).write.partitionBy(name).mode("overwrite").parquet(path)


def read_routed(spark: SparkSession, path: str, schema: str, wanted: DataFrame, key: str, route: Column, name: str = "bucket") -> DataFrame:
    """Rows of the wanted keys, read from those folders alone that the keys lead to; a folder or table that is missing has no rows."""
    try:
        rows = spark.read.schema(f"{schema}, {name} long").option("ignoreMissingFiles", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    keys = wanted.select(key).distinct().withColumn(name, route.cast("long"))
    return rows.join(keys, [name, key], "left_semi").drop(name)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int = 64) -> DataFrame:
    """``df`` as a catalogue table in ``buckets`` buckets by ``key``, sorted within; groups and joins by ``key`` over it need no exchange. An earlier table of the name is replaced."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def create_table(spark: SparkSession, name: str, query: str, key: str, buckets: int = 64) -> DataFrame:
    """The same from SQL text: CREATE TABLE ... AS SELECT, bucketed and sorted by ``key``."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS AS {query}")
    return spark.table(name)


def narrowed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Gzip CSV; False if the output is finished and is not to be overwritten, so a batch can be started again.

    ``<path>.done`` has a row once the output is whole; it is emptied before anything is written.
    """
    spark, mark = df.sparkSession, f"{path}.done"
    if not overwrite and _finished(spark, mark):
        return False
    spark.range(0, 0, 1, 1).write.mode("overwrite").json(mark)
    df.write.mode("overwrite").csv(path, header=True, compression="gzip")
    spark.range(0, 1, 1, 1).write.mode("overwrite").json(mark)
    return True


def _finished(spark: SparkSession, mark: str) -> bool:
    try:
        return not spark.read.schema("id long").json(mark).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def append_parts(parts: list[DataFrame], path: str) -> None:
    """The first part makes the table, the others are appended."""
    for k, part in enumerate(parts):
        part.write.mode("append" if k else "overwrite").parquet(path)


def log_metrics(lines: DataFrame) -> DataFrame:
    """pixel, seconds, n_candidates, n_total and seconds per light curve from log lines (column ``value``)."""
    done = F.regexp_extract("value", r"Healpix (\d+): finished, run in ([0-9.]+)s", 1)
    took = F.regexp_extract("value", r"Healpix (\d+): finished, run in ([0-9.]+)s", 2)
    of = [F.regexp_extract("value", r"Healpix (\d+): (\d+)/(\d+) variable candidates", k) for k in (1, 2, 3)]
    rows = lines.select(F.coalesce(F.nullif(done, F.lit("")), F.nullif(of[0], F.lit(""))).cast("long").alias("pixel"), F.nullif(took, F.lit("")).cast("double").alias("s"), F.nullif(of[1], F.lit("")).cast("long").alias("n"), F.nullif(of[2], F.lit("")).cast("long").alias("m"))
    g = rows.where("pixel IS NOT NULL").groupBy("pixel").agg(F.max("s").alias("seconds"), F.max("n").alias("n_candidates"), F.max("m").alias("n_total"))
    return g.withColumn("per_curve", F.try_divide("seconds", "n_candidates"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table or query in ``parts`` ranges of a column, one connection each."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
