"""Whitening of vectors: their covariance's leading eigenvectors by incremental eigendecomposition, then distributed refinement.

Entries become whole numbers first, ``x = floor(64 c) + 1000000``; each distinct x vector counts once in the fit (the *fit list*).

Each partition of the fit list keeps the spectrum of its own scatter about its own mean. A row moves the mean and adds one centred
rank-one term; the new eigenvalues are the roots of a secular equation, found between neighbouring old ones by rational steps from the
closer pole, all at once; terms along an eigenvector, and eigenvalues that are equal, are deflated. Eigenvectors come from weights that
are recomputed from the roots, so that they stay orthogonal. Spectra are combined in a tree, FAN at a time: each eigenvector of one is a
rank-one term of the other, and so is the way between their means. Last, all rows are projected on the leading directions, the small
matrix of that projection is summed over all partitions about the exact mean and diagonalised (Rayleigh-Ritz), and one more pass
measures how far the whitened covariance is from the identity.

The state of a task, and what visits the driver, is a matrix of the dimension squared (32 kB for 64), whatever the number of rows.

Defined results: vectors that are null, empty or hold a null or an entry that is not finite are dropped, as are vectors whose length is
not the commonest (of equally common ones the greater); entries beyond 2^46 / 64 count as that bound; repeated rows and ids each get their
rows and count once in the fit; a null id stays null; eigenvalues that are zero to double precision give null for ``whitened`` and 0 for
``explained`` (null where all are); fewer dimensions than components give as many components; equal eigenvalues take any basis of
their space; ``deviation`` is null where it doesn't fit a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch, durable

SCALE, OFFSET, BOUND = 64, 1_000_000, 1 << 46
#: Spectra combined by one task of a level.
FAN = 16
#: Directions that the refinement takes in, at least.
LEADING = 64
#: Rows whose sums fit a long: entries are below 2^47.
RUN = 1 << 15
_EPS = np.finfo(np.float64).eps


def _roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """d_j - root_i for the roots of 1 + sum z2_j / (d_j - root), one above each of the rising, distinct d."""
    k = len(d)
    gap = np.append(d[1:] - d[:-1], z2.sum())
    half = gap / 2
    at = np.arange(k)
    # the value halfway tells the closer pole, from which distances are measured
    left = 1 + (z2[:, None] / ((d[:, None] - d) - half)).sum(axis=0) >= 0
    origin = np.where(left | (at == k - 1), at, np.minimum(at + 1, k - 1))
    far = (at < k - 1) & ~left
    away = d[:, None] - d[origin]
    low = np.where(left, 0.0, np.where(far, -half, half))
    high = np.where(left, half, np.where(far, 0.0, gap))
    mu = np.where(far, -half, half)
    todo = at
    for _ in range(80):
        t = away[:, todo] - mu[todo]
        r = z2[:, None] / t
        slope = r / t
        f = 1 + r.sum(axis=0)
        here, last, after = np.arange(len(todo)), todo == k - 1, np.minimum(todo + 1, k - 1)
        low[todo], high[todo] = np.where(f < 0, mu[todo], low[todo]), np.where(f < 0, high[todo], mu[todo])
        rise = np.where(at[:, None] <= todo, slope, 0).sum(axis=0)
        fall = slope.sum(axis=0) - rise
        # poles on either side whose value and slope agree with the terms of that side
        p, q = t[todo, here], t[after, here]
        a, b = p * p * rise, np.where(last, 0.0, q * q * fall)
        c = f - p * rise - np.where(last, 0.0, q * fall)
        mid, prod = c * (p + q) + a + b, p * q * f
        root = np.sqrt(np.maximum(mid * mid - 4 * prod * c, 0))
        step = np.where(mid > 0, 2 * prod / (mid + root), (mid - root) / (2 * c))
        new = mu[todo] + np.where(last, p + a / c, step)
        new = np.where((new > low[todo]) & (new < high[todo]), new, (low[todo] + high[todo]) / 2)
        open_ = (np.abs(f) > 4 * _EPS * (1 + np.abs(r).sum(axis=0))) & (new != mu[todo])
        todo = todo[open_]
        if not len(todo):
            break
        mu[todo] = new[open_]
    return away - mu


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of diag(d) + z z', for rising d."""
    d, z = d.copy(), z.copy()
    k = len(d)
    size = float(np.sqrt(z @ z))
    tol = 8 * _EPS * max(float(np.abs(d).max(initial=0.0)), size * size)
    with np.errstate(all="ignore"):
        on = np.flatnonzero(np.abs(z) * size > tol)
        turned: list[tuple[int, int, float, float]] = []
        if len(on) > 1 and (np.diff(d[on]) <= 2 * tol * (z[on[1:]] ** 2 + z[on[:-1]] ** 2) / np.abs(z[on[1:]] * z[on[:-1]])).any():
            # of two equal ones, a turn leaves the whole term to the second
            kept, p = [], on[0]
            for j in on[1:]:
                r = float(np.hypot(z[p], z[j]))
                c, s = z[j] / r, z[p] / r
                if (d[j] - d[p]) * abs(c * s) <= tol:
                    z[j], z[p] = r, 0.0
                    d[p], d[j] = d[p] * c * c + d[j] * s * s, d[p] * s * s + d[j] * c * c
                    turned.append((p, j, c, s))
                else:
                    kept.append(p)
                p = j
            on = np.array([*kept, p])
        values, vectors = d.copy(), np.eye(k)
        if len(on):
            e, w = d[on], z[on]
            t = _roots(e, w * w) if len(on) > 1 else np.array([[-(w[0] ** 2)]])
            values[on] = e - np.diagonal(t)
            # weights for which the roots found are exact
            m = len(on)
            at = np.arange(m)
            below = at[None, :] < at[:, None]
            other = np.where(below, e[None, :], np.append(e[1:], 0.0)[None, :]) - e[:, None]
            other[:, m - 1] = 1.0
            ratio = -t / other
            weight = np.copysign(np.sqrt(np.abs(ratio.prod(axis=1))), w)
            v = weight[:, None] / t
            vectors[np.ix_(on, on)] = v / np.sqrt((v * v).sum(axis=0))
        for p, j, c, s in reversed(turned):
            x, y = vectors[p].copy(), vectors[j].copy()
            vectors[p], vectors[j] = c * x + s * y, c * y - s * x
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean and scatter about the mean of some rows; the scatter as eigenvalues (rising) and eigenvectors of its span."""

    def __init__(self, dims: int):
        self.n, self.mean = 0, np.zeros(dims)
        self.values, self.vectors = np.zeros(0), np.zeros((dims, 0))

    def term(self, v: np.ndarray) -> None:
        """Adds v v' to the scatter."""
        size = float(np.sqrt(v @ v))
        if size == 0:
            return
        q = self.vectors
        z = q.T @ v
        rest = v - q @ z
        more = q.T @ rest
        z, rest = z + more, rest - q @ more
        beyond = float(np.sqrt(rest @ rest))
        if q.shape[1] < len(v) and beyond > 64 * _EPS * size:
            q, z = np.column_stack([rest / beyond, q]), np.append(beyond, z)
            self.values = np.append(0.0, self.values)
        self.values, turn = secular(self.values, z)
        self.vectors = q @ turn

    def row(self, y: np.ndarray) -> None:
        way = y - self.mean
        self.n += 1
        self.mean = self.mean + way / self.n
        self.term(way * np.sqrt((self.n - 1) / self.n))

    def join(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.term(vector * np.sqrt(value))
        n = self.n + other.n
        way = other.mean - self.mean
        self.term(way * np.sqrt(self.n / n * other.n))
        self.mean, self.n = self.mean + way * (other.n / n), n
        # rounding of many turns
        self.vectors = np.linalg.qr(self.vectors)[0] if self.vectors.shape[1] else self.vectors


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x of the rows that take part."""
    v, bound = F.col("v"), F.lit(float(BOUND))
    valid = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda c: c.cast("double")).alias("v")).where("v IS NOT NULL AND size(v) > 0").where(valid)
    rows = rows.select("id", F.transform(v, lambda c: F.floor(F.greatest(F.least(c * SCALE, bound), -bound)).cast("long") + OFFSET).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["dims"] if lengths else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(df: DataFrame, of, kind: str) -> dict[int, object]:
    """Sums over all batches of the arrays that ``of`` makes of each, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, RUN):
                one = batch.slice(lo, RUN)
                if kind == "long" and rows + one.num_rows > RUN:
                    yield _numbered(total)
                    total, rows = None, 0
                part = of(_matrix(one))
                total, rows = part if total is None else total + part, rows + one.num_rows
        if total is not None:
            yield _numbered(total)

    def _numbered(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "part"])

    whole_sum = F.sum(F.col("part").cast("decimal(38,0)") if kind == "long" else F.col("part"))
    return {r["at"]: r["total"] for r in df.select("x").mapInArrow(run, f"at long, part {kind}").groupBy("at").agg(whole_sum.alias("total")).collect()}


def spectrum(fit: DataFrame, origin: np.ndarray) -> Spectrum:
    """The spectrum of all rows of ``fit``, entries counted from ``origin``."""
    dims = len(origin)
    keep = Scratch(fit.sparkSession)
    schema = "slot long, n long, mean array<double>, vals array<double>, vecs array<double>"

    def pack(slot: int, s: Spectrum) -> dict:
        return {"slot": slot, "n": s.n, "mean": s.mean, "vals": s.values, "vecs": s.vectors.ravel()}

    def unpack(r) -> Spectrum:
        s = Spectrum(dims)
        s.n, s.mean, s.values = int(r["n"]), np.array(r["mean"]), np.array(r["vals"])
        s.vectors = np.array(r["vecs"]).reshape(dims, -1)
        return s

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(dims)
        for batch in batches:
            for y in (_matrix(batch) - origin).astype(np.float64):
                s.row(y)
        if s.n:
            one = pack(TaskContext.get().partitionId(), s)
            yield pa.RecordBatch.from_pylist([one | {c: one[c].tolist() for c in ("mean", "vals", "vecs")}], schema=pa.schema([("slot", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("mean", "vals", "vecs"))]))

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        first, *others = (unpack(r) for _, r in rows.sort_values("slot").iterrows())
        for s in others:
            first.join(s)
        return pd.DataFrame([pack(int(rows["slot"].min()) // FAN, first)])

    level = keep(fit.select("x").mapInArrow(own, schema))
    most = level.agg(F.max("slot")).first()[0]
    while most:
        level, most = keep(level.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(joined, schema)), most // FAN
    out = unpack(level.first())
    keep.free()
    return out


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error of each row that takes part."""
    rows = whole(vectors, id_col, vector_col)
    names = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = durable(rows.select("x").distinct())
    n = fit.count()
    if not n:
        return rows.sparkSession.createDataFrame([], names).withColumnRenamed("id", id_col)
    sums = _sums(fit, lambda x: x.sum(axis=0), "long")
    total = [int(sums[k]) for k in range(len(sums))]
    # n x - S = n (x - origin) - over, exactly, in small numbers
    origin, over = np.array([s // n for s in total]), np.array([s % n for s in total])
    dims = len(origin)
    centred = lambda x: (x - origin).astype(np.float64) - over / n

    found = spectrum(fit, origin)
    leading = found.vectors[:, ::-1][:, : max(LEADING, 4 * components)]
    basis = np.linalg.qr(leading)[0] if leading.shape[1] else np.zeros((dims, 0))

    def projected(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        p = y @ basis
        return np.append((p.T @ p).ravel(), (y * y).sum())

    sums = _sums(fit, projected, "double")
    moment = np.array([sums[k] for k in range(len(sums))]) / n
    trace, m = float(moment[-1]), basis.shape[1]
    small = moment[:-1].reshape(m, m)
    e, turn = np.linalg.eigh((small + small.T) / 2)
    e, axes = e[::-1][:components], basis @ turn[:, ::-1][:, :components]
    sound = e > 16 * dims * _EPS * e.max(initial=0.0)
    e, axes = e[sound], axes[:, sound]
    to_unit = axes / np.sqrt(e)
    k = len(e)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ to_unit
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    error = None
    if k:
        sums = _sums(fit, spread, "double")
        moment = np.array([sums[j] for j in range(len(sums))]) / n
        mean = moment[k * k :]
        error = float(np.abs(moment[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    count = min(components, dims)
    explained = [float(v) / trace for v in e] + [0.0] * (count - k) if trace > 0 else [None] * count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            y = x - origin
            # exact in longs where the rough sum is far from their end
            rough = ((y.astype(np.float64) * n - over) ** 2).sum(axis=1)
            fits = rough < 2.0**62
            exact = np.zeros(len(x), np.int64)
            exact[fits] = ((y[fits] * n - over) ** 2).sum(axis=1)
            for j in np.flatnonzero(~fits & (rough < 2.0**64)):
                one = sum((int(v) * n - int(o)) ** 2 for v, o in zip(y[j], over, strict=True))
                if one < 1 << 63:
                    exact[j], fits[j] = one, True
            w = np.zeros((len(x), count))
            w[:, :k] = centred(x) @ to_unit
            none = np.tile(np.arange(count) >= k, len(x))
            every = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(every),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(none), n)),
                    pa.array(np.repeat(exact, count), mask=np.repeat(~fits, count)),
                    pa.array(w.ravel(), mask=none),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * len(none), pa.float64()),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, names).withColumnRenamed("id", id_col)
