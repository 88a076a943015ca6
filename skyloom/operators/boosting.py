"""Gradient boosting of all classes at once: trees grown level by level from sums of gradients that tasks make and a shuffle adds.

Rows stay in their partitions as blocks of bin numbers. A step (one level of one round's trees, one for each class) is one job: a task adds
the gradients of its blocks by node, feature and bin, the shuffle adds them by class, and the best split of each node alone visits
the driver. Gradients are rounded to multiples of 1 / SCALE, so sums are exact and trees don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.storage import shared_dir

#: Bins of a feature's values; bin 0 besides them holds missing ones.
BINS = 32
SCALE = 1 << 18
#: Rows of a block, rows of a partition, and the least number of partitions.
BLOCK_ROWS, PART_ROWS, PARTS = 40_000, 160_000, 4
#: Rounds between checkpoints of the margins.
CHECKPOINT = 10


@dataclass
class Settings:
    trees: int = 100
    depth: int = 8
    rate: float = 0.15
    #: Least sum of second derivatives of a child, least gain of a split, penalty of a leaf's squared value.
    child: float = 3.0
    gain: float = 2.0
    ridge: float = 1.0
    #: Shares of rows and of features that a tree draws.
    rows: float = 0.8
    features: float = 0.9
    seed: int = 42


@dataclass
class Tree:
    """Nodes in columns; a leaf has the feature -1 and is its own left child. Rows at most ``cut`` go left, as do missing ones where ``missing`` says so."""

    feature: np.ndarray
    cut: np.ndarray
    missing: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int = 0

    @staticmethod
    def root() -> Tree:
        return Tree(np.array([-1]), np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, np.int64), np.zeros(1))


def leaves(tree: Tree, x: np.ndarray, gone: np.ndarray | None, rows: np.ndarray | None = None) -> np.ndarray:
    """The leaf of each row, or of ``rows``; ``x`` has a row for each feature, ``gone`` tells missing values (None: there are none)."""
    n, leaf = x.shape[1], tree.feature < 0
    at = np.arange(n) if rows is None else rows
    first, cut = np.maximum(tree.feature, 0) * n, np.where(leaf, 255 if x.dtype == np.uint8 else np.inf, tree.cut).astype(x.dtype)
    node, flat = np.zeros(len(at), np.int64), x.reshape(-1)
    for _ in range(tree.depth):
        place = first[node] + at
        right = flat[place] > cut[node]
        if gone is not None:
            right = np.where(gone.reshape(-1)[place], ~(tree.missing | leaf)[node], right)
        node = tree.left[node] + right
    return node


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _number(key: int) -> float:
    """The number of which ``_ordered`` makes ``key``."""
    key = np.uint64(key)
    return float((key ^ np.uint64(1 << 63) if key >> np.uint64(63) else ~key).view(np.float64))


def _wanted(cells: np.ndarray, counts: np.ndarray, below: int, n: int) -> np.ndarray:
    """Places of the cells that hold the ends of the bins, of ``n`` values with ``below`` ones before the first cell."""
    ranks = -(-n * np.arange(1, BINS) // BINS)
    ends = below + np.cumsum(counts)
    ranks = ranks[(ranks > below) & (ranks <= ends[-1])]
    return np.unique(np.searchsorted(ends, ranks))


def _cuts(blocks: RDD, features: int) -> list[np.ndarray]:
    """Per feature the upper ends of its bins but the last: values at equal shares of the rows, to 12 bits behind the leading one. Few values have a bin each.

    Counts by the leading 16 bits of the ordered numbers tell the cells that hold an end, those by 24 bits its place.
    """

    def counted(bits: int, chosen: list | None) -> Callable:
        def run(blocks: Iterable) -> Iterator:
            for x, *_ in blocks:
                for f in range(features):
                    key = _ordered(x[f][~np.isnan(x[f])])
                    if chosen is not None:
                        key = key[np.isin(key >> np.uint64(48), chosen[f])]
                    if len(key):
                        yield f, np.unique(key >> np.uint64(64 - bits), return_counts=True)

        return run

    def added(a, b):
        cells, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        return cells, np.bincount(at, np.concatenate([a[1], b[1]])).astype(np.int64)

    def ends(bits: int, chosen: list | None, of: Callable) -> dict:
        return blocks.mapPartitions(counted(bits, chosen)).reduceByKey(added, min(features, 16), lambda f: f).map(lambda r: (r[0], of(*r))).collectAsMap()

    def coarse(f: int, found: tuple) -> tuple:
        cells, counts = found
        at = np.arange(len(cells)) if len(cells) <= BINS else _wanted(cells, counts, 0, int(counts.sum()))
        return cells[at], (np.cumsum(counts) - counts)[at], int(counts.sum())

    first = ends(16, None, coarse)
    none = (np.zeros(0, np.uint64),) * 2 + (0,)
    chosen = [first.get(f, none)[0] for f in range(features)]

    def fine(f: int, found: tuple) -> np.ndarray:
        cells, counts = found
        top, below, n = first[f]
        out = list(cells[:-1])
        if len(cells) > BINS or counts.sum() < n:
            out = []
            for c, b in zip(top, below, strict=True):
                own = cells >> np.uint64(8) == c
                out += [cells[own][k] for k in _wanted(cells[own], counts[own], int(b), n)]
        # the cell's last number
        return np.unique([_number((int(c) + 1 << 40) - 1) for c in out])

    second = ends(24, chosen, fine)
    return [second.get(f, np.zeros(0)) for f in range(features)]


def _drawn(key: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each key."""
    own = 0
    for v in salt:
        own = (own + v + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    mixed = key ^ np.uint64(own)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def shares(margins: np.ndarray) -> np.ndarray:
    """Probabilities of margins with a row for each class."""
    p = np.exp(margins - margins.max(axis=0))
    return p / p.sum(axis=0)


def _gradients(p: np.ndarray, own: np.ndarray, w: np.ndarray) -> np.ndarray:
    """First (real part) and second derivative of the loss by a class's margin, in multiples of 1 / SCALE."""
    return np.rint((p - own) * w * SCALE) + 1j * np.rint(2 * p * (1 - p) * w * SCALE)


def _sums(trees: list[Tree], nodes: list[np.ndarray], columns: list[np.ndarray], round_: int, s: Settings) -> Callable:
    """Task's part of a step: per class, sums of both derivatives by feature, open node and bin."""

    def run(blocks: Iterable) -> Iterator:
        sums = {k: np.zeros((len(columns[k]), len(own) * (BINS + 1)), complex) for k, own in enumerate(nodes) if len(own)}
        for x, y, w, key, m in blocks:
            p, gone = shares(m), x == 0
            gone = gone if gone.any() else None
            for k, out in sums.items():
                slots = np.full(len(trees[k].feature), -1, np.int64)
                slots[nodes[k]] = np.arange(len(nodes[k]))
                rows = np.flatnonzero(_drawn(key, s.seed, round_, k) < s.rows)
                slot = slots[leaves(trees[k], x, gone, rows)]
                rows, base = rows[slot >= 0], slot[slot >= 0] * (BINS + 1)
                both = _gradients(p[k, rows], y[rows] == k, w[rows])
                for j, f in enumerate(columns[k]):
                    np.add.at(out[j], base + x[f][rows], both)
        for k, out in sums.items():
            # half the bytes where they suffice
            out = out.view(float)
            yield k, out.astype(np.int32) if np.abs(out).max() < 1 << 31 else out

    return run


def _best(columns: list[np.ndarray], s: Settings) -> Callable:
    """Of each open node of a class: feature, bin, side of missing values, gain and the sums of the best split's left child and of the node."""

    def run(row: tuple) -> tuple:
        k, sums = row[0], row[1].reshape(len(columns[row[0]]), -1, BINS + 1, 2) / SCALE
        score = lambda a, b: a * a / (b + s.ridge)
        g, h = sums[..., 0], sums[..., 1]
        all_g, all_h = g[0].sum(axis=-1)[:, None], h[0].sum(axis=-1)[:, None]
        # last axis: bins whose upper end is the cut, first with missing values on the left, then on the right
        left_g, left_h = (np.concatenate([np.cumsum(a, axis=-1)[..., 1:-1], np.cumsum(a[..., 1:], axis=-1)[..., :-1]], axis=-1) for a in (g, h))
        gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
        gain[(left_h < s.child) | (all_h - left_h < s.child)] = -np.inf
        nodes, width = gain.shape[1], gain.shape[2]
        at = np.moveaxis(gain, 1, 0).reshape(nodes, -1).argmax(axis=1)
        j, c, n = at // width, at % width, np.arange(nodes)
        return k, (columns[k][j], c % (BINS - 1) + 1, c < BINS - 1, gain[j, n, c], left_g[j, n, c], left_h[j, n, c], all_g[:, 0], all_h[:, 0])

    return run


def _grown(tree: Tree, nodes: np.ndarray, found: tuple, s: Settings) -> tuple[Tree, np.ndarray]:
    """The tree with the splits of its open nodes that gain enough, and its new nodes that may be split again."""
    feature, cut, missing, gain, left_g, left_h, all_g, all_h = found
    good = gain > max(s.gain, 1e-6)
    value = lambda g, h: -s.rate * g / (h + s.ridge)
    if not tree.depth:
        tree.value[0] = value(all_g, all_h)[0]
    at, n = nodes[good], 2 * int(good.sum())
    new = len(tree.feature) + np.arange(n)
    g, h = (np.stack([a[good], b[good] - a[good]], axis=1).reshape(-1) for a, b in ((left_g, all_g), (left_h, all_h)))
    added = (np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), new, value(g, h))
    out = Tree(*(np.concatenate(c) for c in zip((tree.feature, tree.cut, tree.missing, tree.left, tree.value), added, strict=True)), tree.depth + (n > 0))
    out.feature[at], out.cut[at], out.missing[at], out.left[at] = feature[good], cut[good], missing[good], new[::2]
    # a node of less than two children's weight can't be split
    return out, new[(h >= 2 * s.child) & (out.depth < s.depth)]


def _advanced(trees: list[Tree]) -> Callable:
    """Blocks with the margins that the round's trees add."""

    def run(block: tuple) -> tuple:
        x, y, w, key, m = block
        gone = x == 0
        gone = gone if gone.any() else None
        return x, y, w, key, m + np.stack([t.value[leaves(t, x, gone)] for t in trees])

    return run


def _packed(features: int) -> Callable:
    """Arrow batches as blocks of at most BLOCK_ROWS rows and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.stack([t.column(f).cast(pa.float64()).to_numpy() for f in range(features)])
            made = (x, *(t.column(features + k).to_numpy().astype(kind) for k, kind in enumerate((np.int32, np.float64, np.int64))))
            return pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in made], names=["x", "y", "w", "key"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    return run


def _unpacked(features: int) -> Callable:
    def run(row) -> tuple:
        y, w, key = np.frombuffer(row["y"], np.int32), np.frombuffer(row["w"]), np.frombuffer(row["key"], np.uint64)
        x = np.frombuffer(row["x"]).reshape(features, len(y))
        return np.where(np.isfinite(x), x, np.nan), y, w, key

    return run


def _coded(cuts: list[np.ndarray], classes: int) -> Callable:
    """Bin numbers from 1, 0 for missing values, and margins of zero."""

    def run(block: tuple) -> tuple:
        x, y, w, key = block
        codes = np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v)) for v, c in zip(x, cuts, strict=True)]).astype(np.uint8)
        return codes, y, w, key, np.zeros((classes, len(y)))

    return run


def fit(df: DataFrame, features: list[str], label: str, weight: str, key: str, classes: int, rows: int, s: Settings) -> list[list[Tree]]:
    """Trees by round and class, with cuts in the features' own numbers. ``label`` counts classes from 0, ``key`` tells rows apart; non-finite values are missing."""
    spark, kept = df.sparkSession, StorageLevel.MEMORY_AND_DISK
    shared_dir(spark)
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(features)], F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"), F.xxhash64(key).alias("key"))
    parts = max(PARTS, -(-rows // PART_ROWS))
    raw = wide.mapInArrow(_packed(len(features)), "x binary, y binary, w binary, key binary").rdd.map(_unpacked(len(features))).coalesce(parts).persist(kept)
    cuts = _cuts(raw, len(features))
    state = raw.map(_coded(cuts, classes)).persist(kept)
    rng, out, last = np.random.default_rng(s.seed), [], raw
    for round_ in range(s.trees):
        trees, nodes = [Tree.root() for _ in range(classes)], [np.zeros(1, np.int64)] * classes
        columns = [np.sort(rng.permutation(len(features))[: max(1, round(s.features * len(features)))]) for _ in range(classes)]
        while any(map(len, nodes)):
            sums = state.mapPartitions(_sums(trees, nodes, columns, round_, s)).reduceByKey(lambda a, b: a.astype(float) + b, min(classes, parts), lambda k: k)
            for k, found in sums.map(_best(columns, s)).collect():
                trees[k], nodes[k] = _grown(trees[k], nodes[k], found, s)
            if last is not None:
                last.unpersist()
                last = None
        out.append(trees)
        last, state = state, state.map(_advanced(trees)).persist(kept)
        if round_ % CHECKPOINT == CHECKPOINT - 1:
            state.checkpoint()
    for held in (last, state):
        if held is not None:
            held.unpersist()
    named = lambda t: Tree(t.feature, np.array([cuts[f][c - 1] if f >= 0 and c <= len(cuts[f]) else np.inf for f, c in zip(t.feature, t.cut, strict=True)]), t.missing, t.left, t.value, t.depth)
    return [[named(t) for t in trees] for trees in out]


def probabilities(rounds: list[list[Tree]], classes: int, x: np.ndarray) -> np.ndarray:
    """Per row the probability of each class; ``x`` has a row for each feature."""
    gone = ~np.isfinite(x)
    gone = gone if gone.any() else None
    margins = np.zeros((classes, x.shape[1]))
    for trees in rounds:
        for k, t in enumerate(trees):
            margins[k] += t.value[leaves(t, x, gone)]
    return shares(margins).T
