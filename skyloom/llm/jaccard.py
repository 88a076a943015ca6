"""N-gram Jaccard join by a size-aware split into light and heavy sets, and the groups that its links form.

Two sets link when ``den * intersection >= num * union``. Equal sets form one class first; every later step
works on classes.

*Light* sets (few shingles) enumerate their subsets of each fixed size that a partner may require. All sets
with the same subset of c shingles share c, so whether two of them link follows from their sizes alone, and
linking each to the smallest set of the subset connects whatever links: no list of pairs, no verification.

*Heavy* sets go to inverted lists. Shingles are ordered from rare to frequent: an exact count over all sets
(24 bits of the hash besides the bucket, counted within tasks first, so one shuffle of three bytes per shingle) finds the frequent ones,
at most MAX_FREQUENT of which are broadcast; the order decides the cost only, never the result. A set enters
the lists of its first ``n - ceil(t n) + 1`` shingles. Each list has a pivot, and each set is compared with the
pivot that most of its lists have; sets of one component need no further comparison, so a large group of
copies costs one comparison per set. Other pivots and pairs of a list whose sets are still in different components are then compared all, joined by list and size, if size and
position in the order allow a link. Comparison: parity sketches (n / 2 bits or more) give a safe bound first;
of pairs that pass it, one set travels to the other (the pivot, or the set with the smaller name), once.

The boundary between light and heavy is the size where enumerating costs as much as scanning lists. Lists of frequent
shingles are read in parts, light ones as well (a subset is no more frequent than its rarest shingle).

Defined results: null and empty texts and texts without words have 0 shingles and link with nothing; rows with a
null id link with nothing and have a null component; repeated rows are copies of one another; rows of one id
with different texts are different nodes, each with its own component; an empty table gives no rows; very long texts
are read whole, in pieces (``shingles``); of equal ids or sizes the least set comes first, which never changes a group;
other columns are ignored, and ``drop_near_copies`` keeps them whatever their names are. Sets are known by 64-bit hashes; sets of one hash
whose second hash differs (128 bits in all) get names of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch, durable, small
from skyloom.llm.shingles import mix, shingle_sets

#: Bound of the broadcast table of frequent shingles (9 bytes each).
MAX_FREQUENT = 1_000_000
#: A shingle of fewer sets is never called frequent.
LEAST_FREQUENT = 8
#: Cost of scanning one list entry, in enumerated subsets.
SCAN_COST = 8
#: Lists of shingles of this class (log2 of their count) or more are read in parts of about 2^(SPLIT_CLASS - 1) entries.
SPLIT_CLASS = 14
FLUSH = 1 << 20
SEEN = 50_000
#: Shingles of the partners that one part of a hub compares (or 16 times its own), destinations of one row, and bytes of sets that one batch holds.
PART_SHINGLES = 1 << 12
TO_ROW = 1024
SENT = 4 << 20


def needed(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any partner: ceil(t n)."""
    return -(-num * n // den)


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """Sets below this size are light: the cheapest among the sizes where one more shingle may be missing."""
    steps = [d * den // (den - num) + (d * den % (den - num) > 0) for d in range(1, 5)]

    def cost(limit: int) -> int:
        light = sum(c * sum(comb(n, j) for j in range(n - needed(n, num, den) + 1)) for n, c in sizes.items() if n < limit)
        return light + SCAN_COST * sum(c * (n - needed(n, num, den) + 1) for n, c in sizes.items() if n >= needed(limit, num, den))

    return min(steps, key=cost)


def _sid(s: np.ndarray) -> int:
    """A set's 64-bit name."""
    with np.errstate(over="ignore"):
        return int((mix(s).sum(dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) ^ np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))).view(np.int64)) if len(s) else 0


def _twin(s: np.ndarray) -> int:
    """A second 64-bit hash of a set, which tells apart sets of one name."""
    with np.errstate(over="ignore"):
        return int((mix(s ^ np.uint64(0x2127599BF4325C37)).sum(dtype=np.uint64) * np.uint64(0x880355F21E6D1965) ^ np.bitwise_xor.reduce(mix(s + np.uint64(0x9FB21C651E98DF25)))).view(np.int64)) if len(s) else 0


def _named(s: np.ndarray, names: dict[tuple[int, int], int]) -> int:
    """A set's name: its hash, unless others have it too."""
    sid = _sid(s)
    return names.get((sid, _twin(s)), sid) if names else sid


def _sketch(s: np.ndarray) -> bytes:
    """Parity of the set's shingles in a power of two of bits, at least half their number."""
    bits = 1 << max(6, int(len(s) // 2).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference of two sets, from their sketches."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def describe(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, sid and twin (null without shingles or id), n, sketch of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, twin, n, sketch = [], [], [], []
            for i, s in zip(batch.column(0).is_valid(), shingle_sets(batch.column(1), k), strict=True):
                on = len(s) and i.as_py()
                sid.append(_sid(s) if on else None)
                twin.append(_twin(s) if on else None)
                n.append(len(s))
                sketch.append(_sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sid, pa.int64()), pa.array(twin, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())], names=["id", "sid", "twin", "n", "sketch"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sid long, twin long, n long, sketch binary")


class _Fresh:
    """Tells sets that this task has not met lately, so that copies are emitted once."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, sid: int) -> bool:
        if sid in self.seen:
            return False
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(sid)
        return True


def frequent(docs: DataFrame, k: int, text_col: str, shingles: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys (top bits of the hash) of frequent shingles, their class (log2 of their count), and the shift that makes a key."""
    # a bucket holds about a million shingles
    b = min(28, max(4, (shingles >> 20).bit_length()))
    shift = np.uint64(64 - b - 24)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, held, size = _Fresh(), [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            bucket, first = np.unique(keys >> np.uint64(24), return_index=True)
            low = keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            parts, again = [], []
            for i, j in zip(first, [*first[1:], len(keys)], strict=True):
                more = np.flatnonzero(n[i:j] > 1)
                parts.append(low[i:j].tobytes())
                again.append(np.stack([more, n[i:j][more]], axis=1).astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(parts, pa.binary()), pa.array(again, pa.binary())], names=["bucket", "low", "again"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                if len(s) and fresh(_sid(s)):
                    held.append(s >> shift)
                    size += len(s)
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def count(t: pa.Table) -> pa.Table:
        parts = t.column("low").to_pylist()
        raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 3)
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, :3] = raw
        times = np.ones(len(raw))
        at = 0
        for part, again in zip(parts, t.column("again").to_pylist(), strict=True):
            more = np.frombuffer(again, "<u4").reshape(-1, 2)
            times[at + more[:, 0]] = more[:, 1]
            at += len(part) // 3
        low, where = np.unique(wide.view("<u4").ravel(), return_inverse=True)
        n = np.bincount(where, times)
        on = n >= LEAST_FREQUENT
        key = low[on].astype(np.int64) | t.column("bucket")[0].as_py() << 24
        return pa.table({"key": key, "n": np.log2(n[on]).astype(np.int64)})

    found = durable(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(emit, "bucket long, low binary, again binary").groupBy("bucket").applyInArrow(count, "key long, n long"))
    by_class = {r["n"]: r["count"] for r in found.groupBy("n").count().collect()}
    lowest, total = 64, 0
    for c in sorted(by_class, reverse=True):
        if (total := total + by_class[c]) > MAX_FREQUENT:
            break
        lowest = c
    table = found.where(F.col("n") >= lowest).toArrow()
    keys, kind = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.int8)
    order = np.argsort(keys)
    return keys[order], kind[order], int(shift)


def entries(docs: DataFrame, k: int, text_col: str, num: int, den: int, limit: int, keys: np.ndarray, kind: np.ndarray, shift: int, names: dict[tuple[int, int], int]) -> DataFrame:
    """List entries: c (0: inverted list of a shingle; else subset size), token, part (over 0 in split lists), sid, n, r (shingles from this one on)."""
    split = SPLIT_CLASS
    shared = docs.sparkSession.sparkContext.broadcast((keys, kind))
    heavy_from = needed(limit, num, den)

    def of(s: np.ndarray, keys: np.ndarray, kind: np.ndarray) -> list[tuple]:
        n, out = len(s), []
        least = needed(n, num, den)
        rank = np.zeros(n, np.int64)
        if len(keys):
            own = s >> np.uint64(shift)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            rank = np.where(keys[at] == own, kind[at], 0).astype(np.int64)
        # a list is as long as its rarest shingle is frequent, at most
        parts = lambda r: np.where(r >= split, 1 << np.maximum(r - split + 1, 0), 0)
        if n < limit:
            h = mix(s)
            every = h.sum(dtype=np.uint64)
            for c in range(least, n + 1):
                gone = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                left = np.ones((len(gone), n), bool)
                np.put_along_axis(left, gone, False, axis=1)
                rarest = np.where(left, rank, 64).min(axis=1)
                out.append((c, mix((every - h[gone].sum(axis=1, dtype=np.uint64)) ^ np.uint64(c)), np.zeros(len(gone), np.int64), parts(rarest)))
        if n >= heavy_from:
            first = np.argsort(rank, kind="stable")[: n - least + 1]
            out.append((0, s[first], n - np.arange(len(first)), parts(rank[first])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, (keys, kind) = _Fresh(), shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                cols: list[list] = [[], [], [], [], [], []]
                for s in shingle_sets(batch.column(0).slice(lo, 512), k):
                    if not len(s) or not fresh(sid := _named(s, names)):
                        continue
                    for c, token, r, parts in of(s, keys, kind):
                        m = len(token)
                        part = np.where(parts > 0, 1 + sid % np.maximum(parts, 1), 0).astype(np.int32)
                        for col, x in zip(cols, (np.full(m, c, np.int32), token.view(np.int64), part, np.full(m, sid, np.int64), np.full(m, len(s), np.int32), r.astype(np.int32)), strict=True):
                            col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], names=["c", "token", "part", "sid", "n", "r"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "c int, token long, part int, sid long, n int, r int")


def components(edges: DataFrame) -> DataFrame:
    """sid, comp (least sid that is reachable) for the ends of ``edges`` (a, b): labels spread, then jump, until none changes."""
    keep = Scratch(edges.sparkSession)
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = keep(both.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.sid).groupBy(F.col("a").alias("sid")).agg(F.min("comp").alias("near"))
        spread = keep(near.join(labels, "sid").select("sid", F.least("near", "comp").alias("comp"), F.col("comp").alias("old")))
        up = spread.select(F.col("sid").alias("comp"), F.col("comp").alias("top"))
        jumped = keep(spread.join(up, "comp", "left").select("sid", F.coalesce("top", "comp").alias("comp"), (F.coalesce("top", "comp") != F.col("old")).alias("moved")))
        labels = jumped
        if labels.where("moved").isEmpty():
            out = durable(labels.drop("moved"))
            keep.free()
            return out


def links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, id_col: str, text_col: str, num: int, den: int, names: dict[tuple[int, int], int]) -> DataFrame:
    """a, b: those of ``pairs`` (hub, sid) that link.

    Sketches stop most pairs. Of the others, the set of ``sid`` travels once to its hub. A hub is dealt to parts of about
    PART_SHINGLES shingles of its partners, or 16 times its own; its own set goes to each part and is the only one that a task holds.
    """
    keep = Scratch(docs.sparkSession)
    side = lambda x: classes.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [(m + n - _differ(x, y)) // 2 * (num + den) >= num * (m + n) for m, x, n, y in zip(*(batch.column(c).to_pylist() for c in ("n_hub", "sketch_hub", "n_sid", "sketch_sid")), strict=True)]
            yield batch.select(["hub", "sid", "n_hub", "n_sid"]).filter(pa.array(on, pa.bool_()))

    near = keep(pairs.join(side("hub"), "hub").join(side("sid"), "sid").mapInArrow(close, "hub long, sid long, n_hub long, n_sid long"))
    parts = keep(near.groupBy("hub").agg((F.sum("n_sid") / F.greatest(16 * F.max("n_hub"), F.lit(PART_SHINGLES)) + 1).cast("int").alias("parts")))
    routed = keep(near.join(small(parts, 16), "hub").select("hub", "sid", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part")))
    routes = routed.unionByName(routed.select("hub", F.col("hub").alias("sid"), "part").distinct())
    rows = (routes.groupBy("sid").count().agg(F.max("count")).first()[0] or 0) // TO_ROW + 1
    sent = routes.groupBy("sid", F.pmod(F.xxhash64("hub", "part"), F.lit(rows)).alias("row")).agg(F.collect_list(F.struct("hub", "part")).alias("to"))
    sent = keep(sent.join(classes.select("sid", "id"), "sid").select("id", "sid", "to"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, kinds = ["hub", "part", "sid", "members"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for whole in batches:
            held, size = [], 0
            for sid, to, s in zip(whole.column("sid").to_pylist(), whole.column("to").to_pylist(), shingle_sets(whole.column("text"), k), strict=True):
                if not len(s) or _named(s, names) != sid:  # another text of the same id
                    continue
                members = s.tobytes()
                for x in to:
                    held.append((x["hub"], x["part"], sid, members))
                    size += len(members)
                    if size >= SENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=cols)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=cols)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, sid, members in zip(batch.column("hub").to_pylist(), batch.column("sid").to_pylist(), batch.column("members"), strict=True):
                s = np.frombuffer(members.as_buffer(), np.uint64)
                if hub == sid:
                    own = s.copy()
                elif len(np.intersect1d(own, s, assume_unique=True)) * (num + den) >= num * (len(own) + len(s)):
                    a.append(hub)
                    b.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    moved = texts.join(small(sent, 64 + 16 * F.size("to")), "id").mapInArrow(sets, "hub long, part int, sid long, members binary")
    # the hub's own set comes first in each part
    dealt = moved.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("sid") != F.col("hub"))
    found = durable(dealt.mapInArrow(linked, "a long, b long"))
    keep.free()
    return found


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id that links reach, its own included)."""
    return named_groups(docs, k, num, den, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def named_groups(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: id, sid (its set, null without shingles or id), twin (the set's second hash), n, component_id."""
    spark = docs.sparkSession
    keep, heavy = Scratch(spark), Scratch(spark)
    described = durable(describe(docs, k, id_col, text_col))
    sizes = {r["n"]: r["count"] for r in described.where("n > 0").groupBy("n").count().collect()}
    limit = boundary(sizes, num, den)
    classed = lambda rows: rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"), F.min("twin").alias("lo"), F.max("twin").alias("hi"))
    classes, names = keep(classed(described)), {}
    clash = classes.where("lo <> hi").select("sid")
    if not clash.isEmpty():
        # of N sets about N^2 / 2^65 pairs share a hash
        shared = described.join(small(clash, 8), "sid").select("sid", "twin").distinct().collect()
        names = {(r["sid"], r["twin"]): int(mix(np.array([r["sid"], r["twin"]], np.int64).view(np.uint64))[:1].view(np.int64)[0] ^ r["twin"]) for r in shared}
        own = spark.createDataFrame([(*key, name) for key, name in names.items()], "sid long, twin long, name long")
        described = durable(described.join(F.broadcast(own), ["sid", "twin"], "left").withColumn("sid", F.coalesce("name", "sid")).drop("name"))
        classes = keep(classed(described))
    keys, kind, shift = frequent(docs, k, text_col, sum(n * count for n, count in sizes.items()))
    raw = entries(docs, k, text_col, num, den, limit, keys, kind, shift, names)
    group = Window.partitionBy("c", "token", "part")
    lists = raw.withColumns({"lo": F.min("sid").over(group), "hi": F.max("sid").over(group)}).where("part > 0 OR lo <> hi")
    lists = heavy(lists.drop("lo", "hi").distinct().drop("part"))
    # the smallest set of a subset, and of a list the set with the fewest rare shingles before it
    by_subset = heavy(lists.where("c > 0").groupBy("c", "token").agg(F.min(F.struct(F.col("n"), F.col("sid"))).alias("s")))
    by_list = heavy(lists.where("c = 0").groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("r")).alias("p"), F.col("sid"), F.col("n"), F.col("r"))).alias("s")))
    subset = lists.where("c > 0").join(by_subset, ["c", "token"]).where(f"sid <> s.sid AND c * {den} >= {num} * (n + s.n - c)").select(F.col("s.sid").alias("a"), F.col("sid").alias("b"))
    may_link = f"least(r, r2) * {num + den} >= {num} * (n + n2)"
    ordered = [F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")]
    star = lists.where("c = 0").join(by_list, "token").select("sid", "n", "r", F.col("s.sid").alias("sid2"), F.col("s.n").alias("n2"), F.col("s.r").alias("r2"))
    star = keep(star.where(f"sid <> sid2 AND {may_link}").groupBy("sid", "sid2").agg(F.count("*").alias("lists")))
    # each set's most frequent pivot comes first; its other pivots matter only while they are in other components
    first = keep(star.groupBy("sid").agg(F.max_by("sid2", F.struct("lists", "sid2")).alias("sid2")))
    check = lambda pairs: links(docs, classes, pairs, k, id_col, text_col, num, den, names)
    edges = keep(subset.union(check(first.select(F.col("sid2").alias("hub"), "sid"))).distinct())
    comp = components(edges)
    of = lambda x: comp.select(F.col("sid").alias(x), F.col("comp").alias(f"comp_{x}"))
    apart = star.select(*ordered).distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")

    # lists that still hold several components: pairs of different ones, by list and class of size (a partner is in two at most)
    labelled = lists.where("c = 0").join(small(comp.select("sid", "comp"), 32), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    labelled = heavy(labelled.select("token", "sid", "n", "r", "comp"))
    mixed = heavy(labelled.groupBy("token").agg(F.min("comp").alias("main"), F.max("comp").alias("hi")).where("main <> hi").drop("hi"))
    open_ = keep(labelled.join(small(mixed, 32), "token"))
    heavy.free()
    width = lambda n: F.floor(F.log(F.col(n).cast("double") + 0.5) / log(den / num)).cast("int")
    largest = F.floor((F.col("r") * (num + den)) / F.lit(float(num))) - F.col("n")
    big = (
        open_.withColumn("most", F.least(F.col("n").cast("long"), largest).cast("int"))
        .withColumn("least", F.ceil(F.col("n") * num / F.lit(float(den))).cast("int"))
        .where("most >= least")
        .withColumn("size", F.explode(F.sequence(width("least"), width("most"))))
        .drop("most", "least")
    )
    little = open_.select("token", F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("r").alias("r2"), F.col("comp").alias("comp2"), (F.col("comp") == F.col("main")).alias("in_main"), width("n").alias("size"))
    # the main component of a list (the least) needs no pairs of its own
    cond = f"sid <> sid2 AND comp <> comp2 AND (n > n2 OR sid > sid2) AND n2 <= n AND {may_link}"
    minor = big.where("comp <> main").join(little, ["token", "size"])
    major = big.where("comp = main").join(little.where("NOT in_main"), ["token", "size"])
    done = first.select(*ordered).distinct()
    rest = keep(minor.where(cond).select(*ordered).union(major.where(cond).select(*ordered)).union(apart).distinct().join(done, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        comp = components(edges.union(check(rest.select(F.col("a").alias("hub"), F.col("b").alias("sid")))))
    # the least id of a component, told to each of its sets, then to the rows of each set; other rows are alone
    grouped = keep(classes.join(comp.select("sid", "comp"), "sid", "left").where("copies > 1 OR comp IS NOT NULL").select("sid", "id", F.coalesce("comp", "sid").alias("comp")))
    least = keep(grouped.groupBy("comp").agg(F.min("id").alias("component_id")))
    told = durable(grouped.join(small(least, 32), "comp").select("sid", "component_id"))
    keep.free()
    return described.join(small(told, 32), "sid", "left").select("id", "sid", "twin", "n", F.coalesce("component_id", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group one with the least id.

    Rows of an id that occurs once are known by it, others by id and digest of the text.
    """
    found = durable(named_groups(docs, k, num, den, id_col, text_col).select("id", "twin", "component_id"))
    again = durable(found.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias("_id")))
    lost = durable(found.where("id <> component_id").select(F.col("id").alias("_id")).join(small(again, 16), "_id", "left_anti").distinct())
    # the input's columns travel in one struct, so that none of their names matters
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = lambda names: F.col("id") == names["_id"]
    if again.isEmpty():
        return rows.join(small(lost, 16), own(lost), "left_anti").select("row.*")
    once = rows.join(small(again, 16), own(again), "left_anti").join(small(lost, 16), own(lost), "left_anti")
    twice = rows.join(small(again, 16), own(again), "left_semi").withColumn("digest", F.sha2("text", 256))
    keys = describe(twice.select(F.struct("id", "digest").alias("key"), "text"), k, "key", "text").where("sid IS NOT NULL").select("id.*", "twin").distinct()
    keys = keys.join(found.distinct(), ["id", "twin"])
    first = Window.partitionBy("component_id", "id").orderBy("digest")
    keys = durable(keys.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), ((F.col("id") == F.col("component_id")) & (F.row_number().over(first) == 1)).alias("kept")))
    key = (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest"))
    plain = twice.join(small(keys, 100), key, "left_anti")
    elected = twice.join(small(keys.where("kept"), 100), key, "left_semi").dropDuplicates(["id", "digest"])
    return once.select("row").union(plain.select("row")).union(elected.select("row")).select("row.*")
