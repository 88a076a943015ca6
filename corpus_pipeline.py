"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the last
returns their tokens' digests. Every stage's rows are written as Parquet and read again.

Defined results, stage by stage: a null or empty text, or one without letters, has no language and goes at the first; of equal texts, repeated
rows among them, the row with the largest id stays, of equal ids one; of near copies one with the least id (rows with a null id have no
near copies); texts without words are never taken by the mixture, which may take a document once, in part or twice, a row for
each pass; very long texts are read whole, in pieces; an empty table stays empty. Columns besides those of ``documents`` come
through all stages but the last, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import bpe, exact_dedup, jaccard, langid, mixing
from skyloom.llm.common import bound_batches, durable
from skyloom.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    bound_batches(spark)
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the least id."""
    bound_batches(spark)
    return jaccard.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per document and pass with the words that it takes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids and of the text that they decode to."""
    bound_batches(spark)
    return bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary()).select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("language ID", language_id), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing to weights", mix), ("BPE encoding", encode)]

#: Language ID and encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
