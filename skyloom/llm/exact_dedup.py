"""Exact deduplication by a heavy-hitter split.

A Misra-Gries style frequent-items sketch of ``tracked`` counters finds the digests that may be frequent. Their exact counts and
winners are verified in one pass and broadcast (at most ``tracked`` rows, some 100 bytes each), so copies of a frequent text are
settled where they are read and never meet in one task. All other digests go through an ordinary shuffle; the
sketch reports every digest of more than about ``7 / tracked`` of the rows, so no other group is larger than that.

Defined results: a null text equals the empty text; texts are equal when identical without any change, however long;
of equal texts the row with the largest id stays (null ids sort lowest); of repeated rows with the same id and
text exactly one stays; an empty table gives an empty result; other columns of the input are ignored, and ``drop_copies``
keeps them whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import durable, small


def digest(text_col: str = "text"):
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def heavy_digests(digests: DataFrame, tracked: int) -> DataFrame:
    """Verified winners of the frequent digests: digest, heavy_keep, heavy_size; ``tracked`` rows at most."""
    sketch = digests.agg(F.expr(f"approx_top_k(digest, {tracked}, {tracked})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("digest"))
    return (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max("id").alias("heavy_keep"), F.count("*").alias("heavy_size"))
        .where("heavy_size > 1")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 8192) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = durable(docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest")))
    marked = rows.join(F.broadcast(heavy_digests(rows, tracked)), "digest", "left")
    settled = F.col("heavy_size").isNotNull() & ~F.col("id").eqNullSafe(F.col("heavy_keep"))
    group = Window.partitionBy("digest")
    rest = marked.where(~settled).select(
        "id",
        F.coalesce("heavy_keep", F.max("id").over(group)).alias("keep_id"),
        F.coalesce("heavy_size", F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("id").desc_nulls_last())) == 1).alias("kept"),
        "digest",
    )
    losers = marked.where(settled).select("id", F.col("heavy_keep").alias("keep_id"), F.col("heavy_size").alias("group_size"), F.lit(False).alias("kept"), "digest")
    return rest.unionByName(losers).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    lost = durable(exact_dedup(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_digest"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("again")))
    rows = docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest"))
    left = rows.join(small(lost.where("NOT again"), 100), key, "left_anti")
    repeated = lost.where("again").distinct()
    if not repeated.isEmpty():
        repeated = small(repeated, 100)
        once = left.join(repeated, key, "left_semi").dropDuplicates(["id", "digest"])
        left = left.join(repeated, key, "left_anti").unionByName(once)
    return left.select("row.*")
