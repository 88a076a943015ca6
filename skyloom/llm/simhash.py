"""SimHash near copies: 64-bit fingerprints of word shingles, linked within a few bits by the general pigeonhole principle.

A fingerprint's bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of a text's shingles, repeats included.

Search. Equal fingerprints form one class first. The 64 bits are dealt to PARTS parts of WIDTH bits: bits that agree or disagree
often over all classes go to the same part, so that the other parts tell more. Two fingerprints that differ in k bits at most differ,
for any thresholds t of the parts that sum to k - PARTS + 1, in t bits at most of some part; -1 leaves a part out. Each fingerprint
takes its own thresholds: a dynamic program over the parts minimises the values to be probed and the candidates there, counted from a
histogram of all values of each part (PARTS * 2^WIDTH counts at most, whatever the input). Parts whose value is frequent are thereby
left out, and searched with larger thresholds in rarer ones.

Verification. A bucket (part, value) meets those that probe it. Within it, whatever links to a fingerprint joins its group and is never
compared within it again, and each joins by one edge: a dense group of copies yields edges in proportion to its members, not to
their pairs. Buckets of over BLOCK members are split, and each of their probes goes to every block. Components of the edges come next.

Defined results: null and empty texts and texts without words have fingerprint zero, linked like any other; texts with fewer words than
a shingle have one, their whole sequence; rows with a null id get a fingerprint, link with nothing and have a null component; repeated
rows and ids are copies of one another where their texts are; an empty table gives no rows; very long texts are hashed in steps of PIECE
bytes, words beyond that by a running hash; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch, durable, small
from skyloom.llm.jaccard import components

SEED = 42
PIECE = 1 << 20
SLICE = 256
PARTS, WIDTH = 4, 16
#: Cost of probing one value, in compared candidates.
PROBE_COST = 32
#: Members of a bucket in one block, rows that a task holds of one bucket before it compares them, rows that are compared at once.
BLOCK, HELD, STEP = 1 << 15, 1 << 17, 1 << 16
_BITS = np.arange(64, dtype=np.uint64)


def _spans(raw: bytes) -> Iterator[tuple[list[int], list[int]]]:
    """Starts and stops of the words that end in each step of a text."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    open_at = -1
    for at in range(0, len(raw), PIECE):
        blank = space[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)]
        inside = np.concatenate([[open_at >= 0], ~blank]).astype(np.int8)
        edge = np.diff(inside)
        starts, stops = (np.flatnonzero(edge == 1) + at).tolist(), (np.flatnonzero(edge == -1) + at).tolist()
        if open_at >= 0:
            starts.insert(0, open_at)
        open_at = starts.pop() if len(starts) > len(stops) else -1
        yield starts, stops
    if open_at >= 0:
        yield [open_at], [len(raw)]


def _running(raw: bytes, words: list[tuple[int, int]]) -> int:
    """The hash of a shingle that is too long to be copied."""
    h = xxhash.xxh64(seed=SEED)
    for k, (start, stop) in enumerate(words):
        h.update(b" " if k else b"")
        for at in range(start, stop, PIECE):
            h.update(raw[at : min(at + PIECE, stop)].lower())
    return h.intdigest()


def _of_words(words: list[bytes], k: int) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    stops = list(accumulate(len(w) + 1 for w in words))
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *stops], stops[k - 1 :])], np.uint64)  # noqa: B905


def hashes(raw: bytes, k: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in runs."""
    if len(raw) <= PIECE:
        # lower and split know ASCII letters and white space only, in bytes
        words = raw.lower().split()
        if words:
            yield _of_words(words, min(k, len(words)))
        return
    held: list[tuple[int, int]] = []
    several = False
    for starts, stops in _spans(raw):
        words = held + list(zip(starts, stops, strict=True))
        held = words[1 - k :] if k > 1 else []
        if len(words) < k:
            held = words
            continue
        several = True
        if sum(b - a for a, b in words) <= 2 * PIECE:
            yield _of_words([raw[a:b].lower() for a, b in words], k)
        else:
            yield np.array([_running(raw, words[j : j + k]) for j in range(len(words) - k + 1)], np.uint64)
    if held and not several:
        yield np.array([_running(raw, held)], np.uint64)


def fingerprint(raw: bytes, k: int) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes(raw, k):
        for lo in range(0, len(h), STEP):
            ones += np.unpackbits(h[lo : lo + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.bitwise_or.reduce((2 * ones > n).astype(np.uint64) << _BITS))


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (64 bits as a long) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                part = whole.slice(lo, SLICE)
                texts = part.column("text").cast(pa.binary())
                fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", k) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def agreement(fps: DataFrame) -> np.ndarray:
    """How strongly each two of the 64 bits are correlated over all fingerprints (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(both.ravel().astype(np.int64))], names=["at", "n"])

    both, n = np.zeros(4096), max(1, fps.count())
    for r in fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        both[r["at"]] = r["n"] / n
    both = both.reshape(64, 64)
    share = np.diag(both)
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        # a bit that never changes tells nothing and goes with any others
        return np.nan_to_num(np.abs(both - np.outer(share, share)) / np.outer(spread, spread))


def grouped_bits(strength: np.ndarray) -> list[list[int]]:
    """PARTS groups of WIDTH bits: each starts at the bit with the strongest ties left and takes in those tied most to the group."""
    left, groups = set(range(64)), []
    for _ in range(PARTS):
        rest = sorted(left)
        group = [max(rest, key=lambda j: (strength[j, rest].sum(), -j))]
        left.remove(group[0])
        while len(group) < WIDTH:
            group.append(max(sorted(left), key=lambda j: (strength[j, group].sum(), -j)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each part: (parts, rows)."""
    bit = lambda b, to: (fp >> np.uint64(b) & np.uint64(1)).astype(np.int32) << to
    return np.stack([np.bitwise_or.reduce([bit(b, to) for to, b in enumerate(group)]) for group in groups])


def within(histogram: np.ndarray, radius: int) -> np.ndarray:
    """(radius + 1, values): members whose value differs in 0, at most 1, ... bits from each value."""
    exact = np.zeros((radius + 1, len(histogram)))
    exact[0] = histogram
    at = np.arange(len(histogram))
    for b in range(WIDTH):
        other = exact[:, at ^ (1 << b)]
        exact[1:] += other[:-1]
    return np.cumsum(exact, axis=0)


def thresholds(v: np.ndarray, near: np.ndarray, total: int) -> np.ndarray:
    """(parts, rows): the cheapest thresholds from -1 that sum to ``total``, by a dynamic program over the parts."""
    most, n = near.shape[1] - 1, v.shape[1]
    balls = np.cumsum([sum(1 for _ in combinations(range(WIDTH), r)) for r in range(most + 1)])
    sums = range(-PARTS, total + PARTS)
    best = {0: np.zeros(n)}
    chosen: list[dict[int, np.ndarray]] = []
    for part in range(PARTS):
        cost = {-1: np.zeros(n)} | {r: PROBE_COST * balls[r] + near[part, r, v[part]] for r in range(most + 1)}
        after, how = {}, {}
        for s in sums:
            ways = [(r, best[s - r] + cost[r]) for r in cost if s - r in best]
            if ways:
                stack = np.stack([c for _, c in ways])
                pick = stack.argmin(axis=0)
                after[s], how[s] = stack[pick, np.arange(n)], np.array([r for r, _ in ways])[pick]
        best, chosen = after, [*chosen, how]
    out, s = np.zeros((PARTS, n), np.int64), np.full(n, total)
    for part in reversed(range(PARTS)):
        for at in np.unique(s):
            on = s == at
            out[part, on] = chosen[part][int(at)][on]
        s = s - out[part]
    return out


def entries(fps: DataFrame, groups: list[list[int]], histogram: np.ndarray, distance: int) -> DataFrame:
    """bucket (part and value), block, fp, member, probes: each fingerprint in its buckets, and where it asks."""
    total = distance - PARTS + 1
    near = np.stack([within(h, distance) for h in histogram]).astype(np.float32)
    blocks = np.maximum(1, -(-histogram // BLOCK)).astype(np.int32)
    shared = fps.sparkSession.sparkContext.broadcast((near, blocks))
    masks = [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)], np.int32) for r in range(distance + 1)]
    names = ["bucket", "block", "fp", "member", "probes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, blocks = shared.value
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            v = values(fp, groups)
            t = thresholds(v, near, total)
            own = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
            for part in range(PARTS):
                found = []
                home = own % blocks[part, v[part]]
                found.append((v[part], home, np.arange(len(fp)), np.ones(len(fp), bool), t[part] >= 0))
                for r, mask in enumerate(masks):
                    row = np.flatnonzero(t[part] >= r)
                    asked = (v[part, row][:, None] ^ mask).ravel()
                    row = np.repeat(row, len(mask))
                    times = blocks[part, asked]
                    asked, row = np.repeat(asked, times), np.repeat(row, times)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    keep = (block != home[row]) if r == 0 else np.ones(len(row), bool)
                    found.append((asked[keep], block[keep], row[keep], np.zeros(keep.sum(), bool), np.ones(keep.sum(), bool)))
                value, block, row, member, probes = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32) | part << WIDTH), pa.array(block.astype(np.int32)), pa.array(fp[row].view(np.int64)), pa.array(member), pa.array(probes)], names=names)

    return fps.select("fp").mapInArrow(run, "bucket int, block int, fp long, member boolean, probes boolean")


def _forest(member: np.ndarray, probe: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect whatever probe and member of one block link: groups grow from a seed, and what has joined is compared no more."""
    m_left, p_left = np.ones(len(member), bool), np.ones(len(probe), bool)
    step = max(1, (1 << 20) // max(1, len(member)))
    for lo in range(0, len(probe), step):
        asking = lo + np.flatnonzero(p_left[lo : lo + step])
        others = member[m_left]
        hits = np.bitwise_count(probe[asking][:, None] ^ others[None, :]) <= distance
        # its own member is no partner
        for seed in asking[hits.sum(axis=1) > np.isin(probe[asking], others)]:
            if not p_left[seed]:
                continue
            p_left[seed] = False
            joined, front_p, front_m = [], probe[seed : seed + 1], member[:0]
            while len(front_p) or len(front_m):
                m, p = np.flatnonzero(m_left), np.flatnonzero(p_left)
                m, p = m[_close(member[m], front_p, distance)], p[_close(probe[p], front_m, distance)]
                m_left[m] = p_left[p] = False
                front_m, front_p = member[m], probe[p]
                joined += [front_m, front_p]
            joined = np.concatenate(joined)
            yield np.full(len(joined), probe[seed]), joined


def _close(some: np.ndarray, front: np.ndarray, distance: int) -> np.ndarray:
    """Which of ``some`` are within ``distance`` of any of ``front``."""
    out = np.zeros(len(some), bool)
    step = max(1, (1 << 20) // max(1, len(some)))
    for lo in range(0, len(front), step):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        out[left] = (np.bitwise_count(some[left][None, :] ^ front[lo : lo + step, None]) <= distance).any(axis=0)
    return out


def _short_runs(key: np.ndarray, fp: np.ndarray, member: np.ndarray, probes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the buckets of a sorted run of rows: each row against the next, the next but one, ..."""
    a, b = [], []
    for d in range(1, len(key)):
        on = np.flatnonzero(key[d:] == key[:-d])
        if not len(on):
            break
        on = on[(member[on] & probes[on + d]) | (probes[on] & member[on + d])]
        on = on[np.bitwise_count(fp[on] ^ fp[on + d]) <= distance]
        a.append(fp[on])
        b.append(fp[on + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


#: Buckets of fewer rows are compared row by row in one go.
SHORT = 32


def links(dealt: DataFrame, distance: int) -> DataFrame:
    """a, b: edges among the fingerprints of ``entries`` that connect all that differ in ``distance`` bits at most."""

    def compare(key, fp, member, probes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff([*first, len(key)])
        few = np.repeat(size < SHORT, size)
        yield _short_runs(key[few], fp[few], member[few], probes[few], distance)
        for at, n in zip(first[size >= SHORT], size[size >= SHORT], strict=True):
            one = slice(at, at + n)
            yield from _forest(fp[one][member[one]], fp[one][probes[one]], distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)]
        more: list[list[np.ndarray]] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, more, size
            key, fp, member, probes = (np.concatenate(c) for c in zip(held, *more, strict=True))
            open_from = len(key) if last else int(np.searchsorted(key, key[-1]))
            for lo, hi, whole in ((0, open_from, True), (open_from, len(key), False)):
                if whole or hi - lo >= HELD:
                    for a, b in compare(key[lo:hi], fp[lo:hi], member[lo:hi], probes[lo:hi]):
                        on = a != b
                        if on.any():
                            yield pa.RecordBatch.from_arrays([pa.array(a[on].view(np.int64)), pa.array(b[on].view(np.int64))], names=["a", "b"])
            rest = slice(open_from, None)
            held = [key[rest], fp[rest], member[rest], probes[rest]]
            if len(held[0]) >= HELD:
                # its members meet the probes that are still to come
                stay = held[2]
                held = [held[0][stay], held[1][stay], held[2][stay], np.zeros(stay.sum(), bool)]
            more, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block = batch.column("bucket").to_numpy().astype(np.int64), batch.column("block").to_numpy().astype(np.int64)
            more.append([bucket << 32 | block, batch.column("fp").to_numpy().view(np.uint64), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("member", "probes"))])
            size += batch.num_rows
            if size >= STEP:
                yield from flush(False)
        yield from flush(True)

    # members come before those that only ask
    dealt = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.col("member").desc())
    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, k: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id (least id that links reach, its own included)."""
    keep = Scratch(docs.sparkSession)
    described = durable(fingerprints(docs, k, id_col, text_col))
    classes = keep(described.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    groups = grouped_bits(agreement(classes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = values(batch.column("fp").to_numpy().view(np.uint64), groups)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x | part << WIDTH for part, x in enumerate(v)]))], names=["bucket"])

    # PARTS * 2^WIDTH rows at most
    counts = classes.select("fp").mapInArrow(cut, "bucket int").groupBy("bucket").count().toArrow()
    histogram = np.zeros(PARTS << WIDTH, np.int64)
    histogram[counts.column("bucket").to_numpy()] = counts.column("count").to_numpy()
    edges = keep(links(entries(classes, groups, histogram.reshape(PARTS, -1), distance), distance).distinct())
    comp = components(edges)
    grouped = keep(classes.join(small(comp.select(F.col("sid").alias("fp"), "comp"), 32), "fp", "left").where("copies > 1 OR comp IS NOT NULL").select("fp", "least", F.coalesce("comp", "fp").alias("comp")))
    least = keep(grouped.groupBy("comp").agg(F.min("least").alias("component_id")))
    told = durable(grouped.join(small(least, 32), "comp").select("fp", "component_id"))
    keep.free()
    id_ = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return described.join(small(told, 32), "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_.alias("component_id"))
