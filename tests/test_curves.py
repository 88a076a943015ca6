"""Fitted curves against dense algebra and loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import curves, fourier

CURVE = "sourceid long, coef array<double>, cov array<array<double>>"


def made(seed, terms, scale=0.01):
    rng = np.random.default_rng(seed)
    root = rng.normal(size=(2 * terms + 1, 2 * terms + 1)) * scale
    return rng.normal(size=2 * terms + 1), root @ root.T


def row(k, coef, cov):
    return (k, [float(x) for x in coef], [[float(x) for x in line] for line in cov])


def design(p, terms, order=0):
    k = 2 * np.pi * np.arange(1, terms + 1)
    a = np.outer(p, k)
    s, c = [(np.sin(a), np.cos(a)), (k * np.cos(a), -k * np.sin(a)), (-k * k * np.sin(a), -k * k * np.cos(a))][order]
    return np.hstack([np.full((len(p), 1), 0.0 if order else 1.0), s, c])


def test_values_errors_and_derivatives_equal_dense_algebra(spark):
    every = {1: made(1, 3), 2: made(2, 5)}
    df = spark.createDataFrame([*(row(k, *v) for k, v in every.items()), (3, None, None), (4, [], []), (5, [2.0], [[0.09]])], CURVE)
    grid = curves.on_grid(df, 40)
    assert "PythonUDF" not in grid._jdf.queryExecution().toString() and grid.columns == ["sourceid", "phase", "value", "error", "slope", "bend"]
    got = grid.toPandas().sort_values(["sourceid", "phase"])
    assert set(got["sourceid"]) == {1, 2, 5}
    for k, (coef, cov) in every.items():
        g, terms = got[got["sourceid"] == k], (len(coef) - 1) // 2
        x = design(g["phase"].to_numpy(), terms)
        assert np.allclose(g["value"], x @ coef) and np.allclose(g["error"], np.sqrt(np.einsum("pi,ij,pj->p", x, cov, x)))
        assert np.allclose(g["slope"], design(g["phase"].to_numpy(), terms, 1) @ coef) and np.allclose(g["bend"], design(g["phase"].to_numpy(), terms, 2) @ coef)
    flat = got[got["sourceid"] == 5]
    assert np.allclose(flat["value"], 2) and np.allclose(flat["error"], 0.3) and not flat["slope"].any()
    assert curves.on_grid(df.limit(0), 40).count() == 0
    assert df.where("sourceid > 2").select(curves.value(F.lit(0.1)).alias("v"), curves.error(F.lit(0.1)).alias("e")).where("v IS NULL AND e IS NULL").count() == 2


def test_factors_give_back_covariances(spark):
    every = {1: made(1, 3)[1], 2: made(2, 5)[1], 3: np.diag([1.0, 0.0, 4.0]), 4: np.zeros((3, 3))}
    df = spark.createDataFrame([row(k, np.zeros(len(v)), v) for k, v in every.items()], CURVE)
    for r in df.select("sourceid", curves.cholesky("cov").alias("l")).collect():
        full = np.zeros_like(every[r["sourceid"]])
        for i, line in enumerate(r["l"]):
            full[i, : i + 1] = line
        assert np.allclose(full @ full.T, every[r["sourceid"]], atol=1e-12)


def test_covariances_by_draws(spark):
    """At small errors those of amplitudes are linear in the coefficients'; all equal the draws' own by numpy; reruns agree."""
    coef, cov = made(3, 3, 0.002)
    df = spark.createDataFrame([row(1, coef, cov), row(2, *made(4, 2, 0.3)), (3, None, None), (None, [1.0, 2.0, 3.0], [[1.0]])], CURVE)
    got = {(r["sourceid"], r["kind"], r["i"], r["j"]): r["covariance"] for r in curves.covariances(df, "sourceid").collect()}
    again = {(r["sourceid"], r["kind"], r["i"], r["j"]): r["covariance"] for r in curves.covariances(df.repartition(3), "sourceid").collect()}
    assert got.keys() == again.keys() and all(got[k] == pytest.approx(again[k], rel=1e-9, abs=1e-15) for k in got)
    assert {k[0] for k in got} == {1, 2}
    drawn = curves.draws(df, "sourceid").orderBy("sourceid", "draw").collect()
    for source, terms in ((1, 3), (2, 2)):
        mine = [r for r in drawn if r["sourceid"] == source]
        assert len(mine) == 300
        a = np.array([r["amplitudes"] for r in mine])
        want = np.cov(a, rowvar=False)
        assert all(got[source, "amplitudes", i, j] == pytest.approx(want[i, j]) for i in range(terms) for j in range(i, terms))
        for kind in ("phases", "differences"):
            p = np.array([r[kind] for r in mine])
            mean = np.arctan2(np.sin(p).mean(axis=0), np.cos(p).mean(axis=0))
            var = 1 - np.hypot(np.sin(p).mean(axis=0), np.cos(p).mean(axis=0))
            off = np.sin(p - mean)
            corr = off.T @ off / np.sqrt(np.outer((off**2).sum(axis=0), (off**2).sum(axis=0)))
            want = np.where(np.eye(p.shape[1], dtype=bool), var, corr * np.sqrt(np.outer(var, var)))
            assert all(got[source, kind, i, j] == pytest.approx(want[i, j], abs=1e-12) for i in range(p.shape[1]) for j in range(i, p.shape[1]))
    many = {(r["kind"], r["i"], r["j"]): r["covariance"] for r in curves.covariances(df.where("sourceid = 1"), "sourceid", 20000).collect()}
    s, c = coef[1:4], coef[4:]
    size = np.hypot(s, c)
    turn = np.hstack([np.diag(s / size), np.diag(c / size)])
    limit = turn @ cov[1:, 1:] @ turn.T
    assert all(many["amplitudes", i, j] == pytest.approx(limit[i, j], abs=0.05 * math.sqrt(limit[i, i] * limit[j, j])) for i in range(3) for j in range(i, 3))


def test_covariances_neither_join_nor_broadcast(spark):
    """A curve's draws stay in its row: sums by curve sent to the driver for a broadcast grew with the curves."""
    df = spark.createDataFrame([row(1, *made(3, 3)), row(2, *made(4, 1))], CURVE)
    out = curves.covariances(df, "sourceid")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") == 1
    rows = out.collect()
    assert sum(r["sourceid"] == 1 for r in rows) == 6 + 6 + 3 and sum(r["sourceid"] == 2 for r in rows) == 2


def by_loop(t, m, e, period, min_phase, second):
    """Windows that grow step by step."""
    floor, apart = np.percentile(m, 1), second if second is not None else 0.5
    period = period if second is not None else 2 * period
    zero, k, b = None, 0, 0.05
    while True:
        p = ((t - min_phase * (period if second is not None else period / 2)) / period + b) % 1
        first, other = p < b, (p > apart) & (p < apart + b)
        if (first.sum() >= 3 and other.sum() >= 3) or b > apart:
            break
        k += 1
        b = 0.05 + 0.01 * k
    depths = [(((m - floor) / e**2)[x].sum() / (1 / e**2)[x].sum()) if x.any() else None for x in (first, other)]
    return b, int(first.sum()), int(other.sum()), None if None in depths or max(depths) == 0 else min(depths) / max(depths)


def test_depths_from_data_equal_growing_windows(spark):
    rng = np.random.default_rng(5)
    rows, about, want = [], [], {}
    for k, n in enumerate((400, 60, 25, 12, 5, 3, 1)):
        for second in (None, 0.43):
            key = 2 * k + (second is not None)
            t, e = rng.uniform(0, 80, n), rng.uniform(0.01, 0.1, n)
            m = 15 + 0.4 * np.cos(2 * np.pi * t / 1.3) + rng.normal(0, 0.05, n)
            rows += [(key, float(a), float(b), float(c)) for a, b, c in zip(t, m, e, strict=True)]
            about.append((key, 1.3, 0.213, second))
            want[key] = by_loop(t, m, e, 1.3, 0.213, second)
    rows += [(0, None, 1.0, 1.0), (0, 1.0, math.nan, 0.1), (0, 1.0, 1.0, 0.0), (99, 1.0, 1.0, 0.1), (98, 1.0, 1.0, 0.1)]
    about += [(97, 1.3, 0.2, None), (98, None, 0.2, None)]
    lc = spark.createDataFrame(rows, "sourceid long, t double, mag double, emag double")
    curve = spark.createDataFrame(about, "sourceid long, period double, min_phase double, second_phase double")
    got = {r["sourceid"]: r for r in curves.depth_ratio(lc, curve).collect()}
    seen = 0
    for key, (b, n1, n2, ratio) in want.items():
        r = got[key]
        assert (r["n1"], r["n2"]) == (n1, n2), key
        if n1 or n2:
            assert r["half_width"] == pytest.approx(b)
        assert r["peak_ratio_data"] == (None if ratio is None else pytest.approx(ratio))
        seen += ratio is not None
    assert seen > 6 and not {97, 98, 99} & got.keys()
    assert curves.depth_ratio(lc.limit(0), curve).count() == 0


def test_ridges_equal_dense_cross_validation(spark):
    rng = np.random.default_rng(8)
    grid = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
    rows, want = [], {}
    for source, noise in ((1, 0.02), (2, 0.5)):
        t = np.sort(rng.uniform(0, 30, 60))
        u, e = 2 * (t - (t[0] + t[-1]) / 2) / np.ptp(t), np.full(60, noise)
        y = 0.5 * np.cos(2 * np.pi * t / 1.7) + rng.normal(0, noise, 60)
        rows += [(source, *map(float, r)) for r in zip(t, u, y, e**-2.0, strict=True)]
        arg = 2 * np.pi / 1.7 * np.outer(t, np.arange(1, 7))
        x, w = np.hstack([u[:, None] ** np.arange(2), np.sin(arg), np.cos(arg)]), e**-2.0
        a, k, scores = (x * w[:, None]).T @ x, np.tile(np.arange(1, 7), 2), []
        for g in grid:
            hat = x @ np.linalg.solve(a + np.diag(np.concatenate([np.zeros(2), g * w.sum() * k**2]) + np.abs(a).min() * 1e-4), (x * w[:, None]).T)
            scores.append((w * (y - hat @ y) ** 2).sum() / 60 / (1 - np.trace(hat) / 60) ** 2)
        want[source] = scores
    few = [(3, *r[1:]) for r in rows[:8]]
    df = spark.createDataFrame(rows + few, "sourceid long, t double, u double, y double, w double")
    freqs = spark.createDataFrame([(k, 1 / 1.7, 6) for k in (1, 2, 3, 4)], "sourceid long, f double, high int")
    got = {r["sourceid"]: r for r in fourier.ridges(df, freqs, 2, grid).collect()}
    assert set(got) == {1, 2, 3} and got[3]["ridge"] is None and got[3]["scores"] == []
    for source, scores in want.items():
        assert np.allclose(got[source]["scores"], scores, rtol=1e-6) and got[source]["ridge"] == grid[int(np.argmin(scores))]
    assert got[1]["ridge"] <= got[2]["ridge"]


def test_features_meet_the_catalogue(spark):
    values = {f"{n}{d}_{k}": 0.3 + k + (1 if d else 0) for n in ("phi", "amp") for d in ("", "_double") for k in range(4)}
    f = spark.createDataFrame([(1, 7, *values.values()), (2, 8, *values.values())], "sourceid long, n_epochs int, " + ", ".join(f"{c} double" for c in values))
    c = spark.createDataFrame([(1, 5, 3.0, 1.0, 0.5), (3, 5, 1.0, 1.0, 1.0), (None, 5, 1.0, 1.0, 1.0)], "sourceid long, N_epochs int, j double, k double, excess double")
    got = fourier.finalised(f, c, {"JK_col": ("j", "k", "excess")}).collect()
    assert len(got) == 1
    r = got[0].asDict()
    assert r["n_epochs"] == 7 and r["N_epochs_catalogue"] == 5 and r["JK_col"] == pytest.approx(1.5)
    assert r["phi3_phi1"] == pytest.approx((2 * 3.3 - 4 * 1.3) % (2 * math.pi)) and r["a1_a3_double"] == pytest.approx(2.3 / 4.3)
    from skyloom.operators.preparation import ANGLES, RATIOS

    assert {*ANGLES, *RATIOS} <= r.keys()


def test_bands_follow_the_fitted_curve(spark):
    rng = np.random.default_rng(12)
    t, e = rng.uniform(0, 40, 80), rng.uniform(0.01, 0.03, 80)
    x = 0.4 * np.cos(2 * np.pi * t / 1.7 + 0.3) + 0.1 * np.cos(4 * np.pi * t / 1.7 + 1.0)
    y = 14 + 0.6 * x + rng.normal(0, 0.02, 80)
    rows = [(1, 3, *map(float, r)) for r in zip(t, y, e, strict=True)] + [(1, 4, *map(float, r)) for r in zip(t[:40], 28 - y[:40], e[:40], strict=True)] + [(1, 2, 1.0, 14.0, 0.1), (1, 2, 2.0, 14.2, 0.1), (1, 1, 1.0, 14.0, 0.1), (2, 3, 1.0, 14.0, 0.1), (2, 3, 2.0, 14.5, 0.1), (2, 3, 2.5, 14.1, 0.1), (3, 3, 1.0, 1.0, 0.1)]
    lc = spark.createDataFrame(rows + [(1, 3, math.nan, 1.0, 0.1), (1, 3, 1.0, 1.0, None)], "sourceid long, filterid int, t double, mag double, emag double")
    curve = spark.createDataFrame([(1, 1.7, [0.4, 0.1], [0.3, 1.0]), (2, None, [0.4], [0.3]), (4, 1.0, [0.4], [0.3])], "sourceid long, period double, amplitudes array<double>, phases array<double>")
    got = {(r["sourceid"], r["filterid"]): r for r in curves.against_bands(lc, curve).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 3)}
    w = e**-2.0
    a = np.vstack([np.ones(80), x]).T
    slope = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][1]
    own, other = np.average((y - np.average(y, weights=w)) ** 2, weights=w), np.average((x - np.average(x, weights=w)) ** 2, weights=w)
    assert got[1, 3]["nobs"] == 80 and got[1, 3]["scale"] == pytest.approx(slope, rel=1e-8) and got[1, 3]["model"] == pytest.approx(math.sqrt((own - np.median(e) ** 2) / other), rel=1e-8)
    assert got[1, 4]["scale"] is None and got[1, 4]["model"] > 0 and got[1, 2]["scale"] is None and got[1, 2]["model"] is not None
    assert got[1, 1]["model"] is None and got[2, 3]["model"] is None and got[2, 3]["scale"] is None
