"""Mixing of sources to target weights, in fixed-length blocks of words.

Every source is one stream of words (documents by hashed bucket, then id), cut into blocks. Output shards draw
the source of each of their slots, which makes multinomial counts per shard; a source's slots are numbered
across shards, and slot j reads block ``p(j mod blocks)`` of pass ``j div blocks``, where p is a keyed pseudorandom
permutation of the source's block numbers (swap-or-not rounds, another key for each pass). So a source is read whole before any block of it repeats.
A source that the draws would take beyond its quota leaves its last slots to those that fell short, so every
source gets its quota of blocks exactly. Blocks are joined by number.

Offsets come from sums per bucket, so no task holds a source; the table of sources stays a table, whose targets
are found by a few aggregates. Everything is hashed or computed, so reruns agree.

Defined results: a null or empty text has size 0 and is never taken; the null source is a source of its own, last in
order; repeated rows are mixed each; ties in the order of a stream go to the smaller id, then hash; very long texts are
split into words in one task each, where a pass takes them in part; an empty table gives no rows; columns besides id, source and text pass
through ``mixed_documents`` unchanged, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import durable, small
from skyloom.operators.ordering import numbered, running_total

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
SLOTS_PER_SHARD = 1 << 16
#: Rounds of the permutation.
ROUNDS = 24
#: Slots that one task lays out.
SLOTS_PER_TASK = 1 << 18
#: Runs that an order is cut into, so that ranges meet by equal numbers.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sources`` (s, source_size) with target: words by weight, none above ``most`` times its size, the excess dealt again by weight.

    The level, words per weight, rises until no further source is full; each round is one aggregate.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    bound = F.lit(float(most)) * F.col("source_size")
    level, before = 0.0, -1
    while True:
        full = bound < F.col("weight") * level
        r = rows.agg(F.sum("source_size").alias("size"), F.count_if(full).alias("n"), F.sum(F.when(full, bound)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["n"] == before or not r["open"]:
            break
        before, level = r["n"], (share * r["size"] - (r["used"] or 0.0)) / r["open"]
    return rows.withColumn("target", F.least(bound, F.col("weight") * level)).drop("weight")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a keyed pseudorandom permutation of 0 .. n - 1 puts x, for any n: each round pairs every number with one other and swaps a random half of the pairs."""

    def swap(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(1), i, *key), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(2), i, F.greatest(at, other), *key), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def _cells(lo: str, hi: str, width: int) -> Column:
    """The runs of ``width`` numbers that a range meets."""
    return F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))


class Mix:
    """The plan of a mixture: ``sources``, ``rows`` (documents with offsets), ``slots`` (blocks of the output), ``pieces`` (document parts of blocks)."""

    def __init__(self, docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...], share: float, most: float, block: int, seed: int):
        self.block = block
        sized = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), row_hash(source_col, text_col).alias("hash"), word_count(F.col(text_col).cast("string")).alias("size")))
        found = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last(), name="s")
        blocks = F.ceil(F.col("source_size") / block)
        quota = F.coalesce(F.round(F.try_divide(F.col("target") * blocks, F.col("source_size"))), F.lit(0)).cast("long")
        self.sources = durable(with_targets(found, weights, share, most).withColumns({"blocks": blocks.cast("long"), "quota": quota}))
        names = self.sources.select(F.col("source").alias("name"), "s", "source_size", "target")
        of = Window.partitionBy("s", "bucket")
        rows = sized.withColumn("bucket", F.pmod(F.xxhash64("id", "hash"), F.lit(BUCKETS)).cast("int"))
        rows = rows.join(small(names, 64 + F.coalesce(F.octet_length("name"), F.lit(0))), rows.source.eqNullSafe(names.name)).drop("source", "name")
        base = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
        base = base.select("s", "bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).alias("base"))
        before = F.sum("size").over(of.orderBy("id", "hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        self.rows = durable(rows.withColumn("before", before).join(base, ["s", "bucket"]).withColumn("offset", F.col("base") + F.col("before")).drop("base", "before", "bucket"))
        self.slots = self._slots(docs, seed)

    def _slots(self, docs: DataFrame, seed: int) -> DataFrame:
        """s, block, pass, shard of every slot of the output."""
        plan = self.sources.select("s", "blocks", "quota")
        total = plan.agg(F.sum("quota")).first()[0] or 0
        ends = running_total(plan.where("quota > 0"), "s", "quota", "hi").withColumn("lo", F.col("hi") - F.col("quota"))
        width = max(1, -(-total // CELLS))
        ranges = ends.select("s", "lo", "hi", _cells("lo", "hi", width).alias("cell"))
        draws = docs.sparkSession.range(total).select(F.expr(f"id div {SLOTS_PER_SHARD}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("v"))
        draws = draws.withColumn("cell", F.floor(F.col("v") / width)).join(small(ranges, 48), "cell").where("v >= lo AND v < hi")
        counts = draws.groupBy("shard", "s").agg(F.count("*").alias("n"))
        counts = durable(counts.withColumn("first", F.sum("n").over(Window.partitionBy("s").orderBy("shard")) - F.col("n")))
        # what overdrawn sources leave goes to those that fell short
        got = counts.groupBy("s").agg(F.sum("n").alias("got"))
        short = plan.join(got, "s", "left").withColumn("have", F.coalesce("got", F.lit(0))).withColumn("need", F.col("quota") - F.col("have")).where("need > 0")
        short = durable(running_total(short.select("s", "have", "need"), "s", "need", "hi").withColumn("lo", F.col("hi") - F.col("need")))
        drawn = counts.join(small(plan, 32), "s").withColumn("used", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("first"))))
        taken = drawn.where("used > 0").select("shard", "s", "first", F.col("used").alias("n"))
        vacant = drawn.where("used < n").groupBy("shard").agg(F.sum(F.col("n") - F.col("used")).alias("free"))
        vacant = durable(running_total(vacant, "shard", "free", "v1").withColumn("v0", F.col("v1") - F.col("free")))
        width = max(1, -(-(vacant.agg(F.max("v1")).first()[0] or 0) // CELLS))
        wanted = short.withColumn("cell", _cells("lo", "hi", width))
        offered = vacant.withColumn("cell", _cells("v0", "v1", width))
        met = offered.join(small(wanted, 56), "cell").where(f"v0 < hi AND lo < v1 AND floor(greatest(v0, lo) / {width}) = cell")
        filled = met.select("shard", "s", (F.col("have") + F.greatest("v0", "lo") - F.col("lo")).alias("first"), (F.least("v1", "hi") - F.greatest("v0", "lo")).alias("n"))
        # few rows make many slots: runs of them are dealt to a stated number of tasks, which adaptive execution leaves alone
        run = SLOTS_PER_SHARD // 4
        runs = taken.unionByName(filled).select("shard", "s", F.col("first"), (F.col("first") + F.col("n")).alias("stop"))
        runs = runs.select("shard", "s", "stop", F.explode(F.expr(f"sequence(first, stop - 1, bigint({run}))")).alias("first"))
        runs = runs.repartition(max(1, -(-total // SLOTS_PER_TASK)), F.xxhash64("s", "first"))
        each = runs.select("shard", "s", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + run, "stop") - 1)).alias("j"))
        each = each.join(small(plan, 32), "s").withColumn("pass", F.expr("j div blocks"))
        return each.select("s", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("s"), F.col("pass")).alias("block"), "pass", "shard")

    def pieces(self) -> DataFrame:
        """s, offset, size, block, start, words: parts of documents that lie in one block."""
        end = F.col("offset") + F.col("size")
        cut = self.rows.where("size > 0").select("s", "offset", "size", F.explode(F.sequence(F.expr(f"offset div {self.block}"), F.expr(f"(offset + size - 1) div {self.block}"))).alias("block"))
        start = F.greatest(F.col("offset"), F.col("block") * self.block)
        return cut.select("s", "offset", "size", "block", (start - F.col("offset")).alias("start"), (F.least(end, (F.col("block") + 1) * self.block) - start).alias("words"))


def row_hash(source_col: str, text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.col(source_col).cast("string"), F.lit("/"), F.col(text_col).cast("string"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = 17) -> Mix:
    return Mix(docs, id_col, source_col, text_col, weights, share, most, block, seed)


def mixture(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken."""
    m = mix(docs, id_col, **options)
    # slots come from exploded ranges, whose size Spark takes for that of the ranges: without the hint it would broadcast them
    times = m.slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    taken = m.pieces().join(times.hint("merge"), ["s", "block"]).groupBy("s", "offset").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = m.rows.withColumn("at", F.when(F.col("size") > 0, F.col("offset")))
    joined = rows.join(taken.withColumnRenamed("offset", "at").hint("merge"), ["s", "at"], "left")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", source_col: str = "source", **options) -> DataFrame:
    """The mixture as documents: a row per document and pass with the words that this pass takes, columns as in ``docs``.

    A document that a pass takes whole keeps its text; of one taken in part the words are joined by a space. Each text
    travels once to its parts and is split into words once.
    """
    m = mix(docs, id_col, source_col, text_col, **options)
    part = F.struct("pass", "start", "words")
    drawn = m.pieces().join(m.slots.drop("shard").hint("merge"), ["s", "block"]).groupBy("s", "offset").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    same = Window.partitionBy("id", "hash")
    keyed = m.rows.where("size > 0").withColumn("copy", F.row_number().over(same.orderBy("offset"))).select("id", "hash", "copy", "s", "offset", "size")
    drawn = drawn.join(keyed.hint("merge"), ["s", "offset"]).drop("s", "offset")
    full = docs.select(F.col(id_col).alias("id"), row_hash(source_col, text_col).alias("hash"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # copies of a row are numbered; of most rows there is one
    twice = durable(m.rows.groupBy("id", "hash").count().where("count > 1").select(F.col("id").alias("id2"), F.col("hash").alias("hash2")))
    if twice.isEmpty():
        full = full.withColumn("copy", F.lit(1))
    else:
        met = F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2"))
        again = full.join(small(twice, 24), met, "left_semi").withColumn("copy", F.row_number().over(same.orderBy(F.lit(0))))
        full = full.join(small(twice, 24), met, "left_anti").withColumn("copy", F.lit(1)).unionByName(again)
    drawn = drawn.withColumnsRenamed({"id": "id2", "hash": "hash2", "copy": "copy2"})
    joined = full.join(drawn.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2")) & (F.col("copy") == F.col("copy2")))
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p["words"])
    of_pass = F.transform(F.array_distinct(F.transform("parts", lambda p: p["pass"])), lambda q: F.filter("parts", lambda p: p["pass"] == q))
    takes = joined.select("row", "text", "size", of_pass.alias("takes"))
    in_part = F.exists("takes", lambda parts: total(parts) < F.col("size"))
    each = takes.withColumn("words", F.when(in_part, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).select("row", "text", "size", "words", F.explode("takes").alias("take"))
    cut = F.array_join(F.flatten(F.transform("take", lambda p: F.slice("words", (p["start"] + 1).cast("int"), p["words"].cast("int")))), " ")
    taken = each.select("row", F.when(total(F.col("take")) == F.col("size"), F.col("text")).otherwise(cut).alias("taken"))
    value = {text_col: F.col("taken"), length_col: F.length("taken")}
    return taken.select([value.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
