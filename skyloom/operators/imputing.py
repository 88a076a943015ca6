"""Nearest-neighbour imputer: blocks of incomplete rows meet slices of donors, both of bounded size, wherever Spark puts them.

Distance is over the features that both rows have, scaled to all. Equal distances go to the smallest tie (a hash of the donor's id),
then value. Every pair of an incomplete row and a donor is compared, so work grows with their product; memory doesn't.

Defined results: values that are not finite count as null; rows without any value stay as they are, as do nulls that no donor with a
common feature can fill; equal incomplete rows are compared once; a table without donors fills nothing; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.expr import finite
from skyloom.operators.storage import Scratch, durable

#: Numbers that a block of incomplete rows holds, and a slice of donors; rows of one comparison; slices whose results meet at once.
BLOCK_CELLS = SLICE_CELLS = 1 << 21
ASKED, MET = 128, 32
#: Blocks times slices, at least (while both have rows): tables of few rows meet in all tasks too.
GROUPS = 64
#: Donors beyond k that a row is compared with exactly, so that each feature finds its k among them.
SPARE = 12


def _distances(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distances over the features that both rows have, scaled to all; infinite without any."""
    x0, d0 = np.nan_to_num(x), np.nan_to_num(d)
    xk, dk = (~np.isnan(x)).astype(float), (~np.isnan(d)).astype(float)
    n = xk @ dk.T
    total = np.zeros_like(n)
    # one feature at a time: exact where rows are equal, and no more memory than the result
    for a, b, ak, bk in zip(x0.T, d0.T, xk.T, dk.T, strict=True):
        gap = (a[:, None] - b) * ak[:, None] * bk
        total += gap * gap
    return np.where(n > 0, total * x.shape[1] / np.maximum(n, 1), np.inf)


def _own_distances(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``_distances`` of rows taken together, one pair each, by the same sums."""
    gap = np.nan_to_num(x - d)
    n, total = (~np.isnan(x) & ~np.isnan(d)).sum(axis=1), np.zeros(len(x))
    for g in gap.T:
        total += g * g
    return np.where(n > 0, total * x.shape[1] / np.maximum(n, 1), np.inf)


def _parts(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values without nulls, where they are known, and their squares."""
    own = np.nan_to_num(d)
    return own, (~np.isnan(d)).astype(float), own * own


def _candidates(x: np.ndarray, donors: tuple[np.ndarray, np.ndarray, np.ndarray], few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Pairs of rows (of x, of the donors, which come as ``_parts``) that hold all donors up to a reach, and the reach of each row of x: its ``few`` nearest lie within.

    Distances by three matrix products are off by some 1e-14 of the squares that they are made of; the reach allows for far more. None where
    these squares are too large for that.
    """
    (x0, xk, xx), (d0, dk, dd) = _parts(x), donors
    most = xx.sum(axis=1)[:, None].max() + dd.sum(axis=1).max()
    if not most < 1e280:
        return None
    n = xk @ dk.T
    near = xx @ dk.T
    near += xk @ dd.T
    near -= (2 * x0) @ d0.T
    near *= x.shape[1] / np.maximum(n, 1)
    near[n == 0] = np.inf
    slack = 1e-11 * most * x.shape[1]
    reach = np.partition(near, few - 1, axis=1)[:, few - 1] + slack
    q, p = np.nonzero((near <= reach[:, None] + slack) & np.isfinite(near))
    return q, p, reach


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def nearest_donors(x: np.ndarray, d: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row of ``x``, feature that it misses, distance, tie and value of its k nearest donors that have the feature."""
    out = [[], [], [], [], []]

    def take(q: np.ndarray, j: np.ndarray, near: np.ndarray, p: np.ndarray) -> None:
        """Adds the k nearest of each row and feature."""
        order = np.lexsort((d[p, j], tie[p], near, j, q))
        q, j, near, p = q[order], j[order], near[order], p[order]
        pair = q * d.shape[1] + j
        few = np.arange(len(q)) - np.searchsorted(pair, pair) < k
        for col, v in zip(out, (q[few], j[few], near[few], tie[p[few]], d[p[few], j[few]]), strict=True):
            col.append(v)

    if not len(d):
        return tuple(np.zeros(0) for _ in out)
    some, donors = min(len(d), k + SPARE), _parts(d)
    for first in range(0, len(x), ASKED):
        part = x[first : first + ASKED]
        asked = np.argwhere(np.isnan(part))
        left = asked
        found = _candidates(part, donors, some) if some < len(d) else None
        if found:
            q, p, reach = found
            near = _own_distances(part[q], d[p])
            inside = near <= reach[q]
            q, p, near = q[inside], p[inside], near[inside]
            row, j = np.nonzero(np.isnan(part[q]) & ~np.isnan(d[p]))
            # all donors within a row's reach are here, so a feature that k of them have is done
            pair = q[row] * d.shape[1] + j
            full = np.flatnonzero(np.bincount(pair, minlength=part.size) >= k)
            own = np.isin(pair, full)
            take(first + q[row][own], j[own], near[row][own], p[row][own])
            left = asked[~np.isin(asked[:, 0] * d.shape[1] + asked[:, 1], full)]
        if not len(left):
            continue
        rows = np.unique(left[:, 0])
        dist = _distances(part[rows], d)
        for j in np.unique(left[:, 1]).tolist():
            able = np.flatnonzero(~np.isnan(d[:, j]))
            own = np.searchsorted(rows, left[left[:, 1] == j, 0])
            if not len(able):
                continue
            near = dist[np.ix_(own, able)]
            last = np.partition(near, min(k, len(able)) - 1, axis=1)[:, min(k, len(able)) - 1]
            q, p = np.nonzero((near <= last[:, None]) & np.isfinite(near))
            take(first + rows[own[q]], np.full(len(q), j), near[q, p], able[p])
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def donors_of(df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """tie and d (all features) of the rows that have any."""
    known = F.greatest(*[finite(c).isNotNull() for c in features]) if len(features) > 1 else finite(features[0]).isNotNull()
    return df.where(known).select(F.xxhash64(id_col).alias("tie"), F.array(*[finite(c) for c in features]).alias("d"))


def _dealt(key: Column, rows: int, width: int, cells: int, least: int = 1) -> tuple[Column, int]:
    """Number of a row's part, and how many parts hold about ``cells`` numbers each; ``least`` at least."""
    parts = max(least, -(-rows * width // cells))
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"), parts


def imputed(df: DataFrame, features: list[str], donors: DataFrame, k: int = 5) -> DataFrame:
    """``df`` with finite features, nulls filled from ``donors`` (``donors_of`` the same features)."""
    keep, width = Scratch(df.sparkSession), len(features)
    df = df.withColumns({c: finite(c) for c in features})
    vector = F.array(*features)
    open_ = F.exists("_x", lambda v: v.isNull()) & F.exists("_x", lambda v: v.isNotNull())
    # results name a row by its number; a row of numbers would be repeated with each of its donors
    asks = keep(df.select(vector.alias("_x")).where(open_).distinct().withColumn("_i", F.monotonically_increasing_id()))
    n = asks.count()
    if not n:
        return df
    held = keep(donors)
    slice_, slices = _dealt(F.col("tie"), held.count(), width, SLICE_CELLS)
    block, blocks = _dealt(F.col("_i"), n, width, BLOCK_CELLS, -(-GROUPS // slices))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select(block.alias("block"), every(slices).alias("slice"), "_i", "_x")
    right = held.select(every(blocks).alias("block"), slice_.alias("slice"), "tie", "d")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        x = _rows(a.column("_x"), width)
        d, tie = (_rows(b.column("d"), width), b.column("tie").to_numpy()) if b.num_rows else (np.zeros((0, width)), np.zeros(0, np.int64))
        row, j, dist, tie, v = nearest_donors(x, d, tie, k) if len(x) else (np.zeros(0),) * 5
        names = pa.array(a.column("_i").to_numpy()[row.astype(np.int64)])
        part = a.column("slice")[0].as_py() // MET if len(x) else 0
        return pa.table([names, pa.array(j.astype(np.int32)), pa.array(np.full(len(row), part, np.int32)), *(pa.array(c) for c in (dist.astype(float), tie.astype(np.int64), v.astype(float)))], names=["_i", "j", "part", "dist", "tie", "v"])

    near = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(meet, "_i long, j int, part int, dist double, tie long, v double")
    best = lambda rows: F.slice(F.array_sort(rows), 1, k)
    one = F.collect_list(F.struct("dist", "tie", "v"))
    some = near.groupBy("_i", "j", "part").agg(best(one).alias("b"))
    some = some.groupBy("_i", "j").agg(best(F.flatten(F.collect_list("b"))).alias("b"))
    mean = F.aggregate("b", F.lit(0.0), lambda a, s: a + s["v"]) / F.size("b")
    filled = durable(some.groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("j", mean))).alias("_f")).join(asks, "_i").drop("_i"))
    keep.free()
    out = df.withColumn("_x", vector).join(filled, "_x", "left")
    return out.withColumns({c: F.coalesce(c, F.try_element_at("_f", F.lit(j))) for j, c in enumerate(features)}).drop("_x", "_f")


def knn_impute(df: DataFrame, features: list[str], id_col: str, k: int = 5) -> DataFrame:
    """id and features; nulls filled with the mean of the k nearest other rows that have them."""
    return imputed(df.select(id_col, *features), features, donors_of(df, features, id_col), k)
