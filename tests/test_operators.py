"""Traps and properties of the operators on small frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.functions import sky as S
from skyloom.operators.quantiles import exact_percentiles
from skyloom.operators import fourier, imputing, joins, learning, quality, series, stats
from skyloom.sources import files


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_quality_cut_keeps_what_is_unknown(spark):
    rows = [
        (1, 12.0, 0.1, 9.0, 1.0, False), (2, 14.0, 0.1, 9.0, 1.0, False), (3, 12.0, 0.1, float("nan"), 1.0, False), (4, 12.0, 0.1, None, None, None),
        (5, 12.0, 0.0, 1.0, 1.0, False), (6, 12.0, 0.1, 1.0, 12.0, False), (7, 12.0, 0.1, 1.0, 1.0, True), (8, None, None, 9.0, 1.0, False),
    ]
    df = spark.createDataFrame(rows, "event_id int, mag double, emag double, chi double, ast_res_chisq double, ambiguous_match boolean")
    assert [r[0] for r in values(quality.quality_cut(df), "event_id")] == [2, 3, 4, 8]


def test_sigma_clip_leaves_flat_and_single_groups(spark):
    df = spark.createDataFrame([(1, float(k % 5)) for k in range(50)] + [(1, 100.0), (2, 3.0), (3, 1.0), (3, 1.0), (3, 1.0)], "sourceid int, mag double")
    kept = quality.sigma_clip(df)
    assert kept.where("sourceid = 1").count() == 50 and kept.where("sourceid > 1").count() == 4


def test_scalars(spark):
    df = spark.createDataFrame([(float("inf"), -1.5), (float("nan"), 0.0), (100.0, 7.0)], "x double, t double")
    assert [r[0] for r in df.select(expr.log10_positive("x")).collect()] == [None, None, 2.0]
    assert [round(r[0], 6) for r in df.select(expr.phase("t", F.lit(1.0))).collect()] == [0.5, 0.0, 0.0]
    assert [r[0] for r in df.select(expr.ratio("t", F.lit(0.0))).collect()] == [None] * 3


def test_percentiles_of_a_column_in_passes(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.lognormal(0, 3, 3000), np.full(900, 2.0), rng.normal(-5, 0.001, 500)])
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)], "x double, y double")
    marks = [0.0, 0.001, 0.25, 0.5, 0.777, 0.999, 1.0]
    for few in (1, 50, 10_000):
        got = exact_percentiles(df, ["x", "y"], marks, few)
        assert got["x"] == pytest.approx(list(np.quantile(x, marks)), rel=1e-12) and got["y"] == [None] * len(marks)


def test_histogram_holds_its_last_edge(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (10.1,), (-0.1,), (None,)], "x double")
    h = {r["bin"]: r["n"] for r in stats.histogram(df, "x", 0, 10, 5).collect()}
    assert h == {0: 2.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_interpolation_is_clamped(spark):
    knots = spark.createDataFrame([(0.0, 1.0), (10.0, 3.0), (20.0, 3.0)], "a double, b double")
    df = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (15.0,), (25.0,)], "x double")
    got = values(stats.interpolate(df, "x", knots, "a", "b", "y"), "x", "y")
    assert [y for _, y in got] == list(np.interp([x for x, _ in got], [0, 10, 20], [1, 3, 3]))


def test_weighted_mean_skips_zero_errors(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (4.0, 1.0), (None, 1.0)], "x double, e double")
    assert df.agg(stats.weighted_mean("x", "e")).collect()[0][0] == 3.0


def test_cross_match_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 400
    lon, lat = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    lon[:6], lat[:6] = [359.9, 0.1, 10, 190, 45, 45.0], [0, 0, 89.9, 89.9, -90, -89.5]
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat, strict=True))]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    got = {r[0]: (r[1], r[2]) for r in joins.cross_match(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 4.0).collect()}
    a, b = np.radians(lon), np.radians(lat)
    xyz = np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)
    d = np.degrees(2 * np.arcsin(np.minimum(1, np.linalg.norm(xyz[:, None] - xyz[None], axis=2) / 2)))
    want = {i: j for i in range(0, n, 2) if d[i, j := 1 + 2 * int(d[i, 1::2].argmin())] < 4.0}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(abs(d[k, j] - s) < 1e-6 for k, (j, s) in got.items())


def test_nearest_in_time_prefers_the_earlier(spark):
    a = spark.createDataFrame([(1, 5.0, "a"), (1, 9.0, "b"), (2, 1.0, "c")], "k int, t double, n string")
    b = spark.createDataFrame([(1, 4.0, 40.0), (1, 6.0, 60.0), (1, 9.0, 90.0)], "k int, t double, v double")
    assert values(joins.nearest_in_time(a, b, "k", "t", 2.0, ["v"]), "n", "nearest_t", "nearest_v") == [("a", 4.0, 40.0), ("b", 9.0, 90.0)]


def test_pixels_are_equal_in_area_and_nested(spark):
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(0, 360, 60_000), np.degrees(np.arcsin(rng.uniform(-1, 1, 60_000)))
    df = spark.createDataFrame(pd.DataFrame({"lon": lon, "lat": lat}))
    for name, level, nested in (("fine", 3, True), ("coarse", 1, True), ("mid", 2, True), ("ring", 2, False)):
        df = S.with_pixel(df, name, "lon", "lat", level, nested)
    p = df.toPandas()
    assert (p.fine // 16 == p.coarse).all() and (p.fine // 4 == p.mid).all()
    for name in ("mid", "ring"):
        n = np.bincount(p[name], minlength=192)
        assert len(n) == 192 and abs(n - n.mean()).max() < 6 * math.sqrt(n.mean())
    # both orders number the same pixels, and ring numbers fall from north to south
    assert len(p[["mid", "ring"]].drop_duplicates()) == 192
    assert (p.groupby("ring").lat.mean().diff().dropna() < 3).all()
    poles = spark.createDataFrame([(x, y) for y in (90.0, -90.0) for x in (0.0, 90.0, 180.0, 270.0)], "lon double, lat double")
    for nested in (True, False):
        assert [r["p"] for r in S.with_pixel(poles, "p", "lon", "lat", 0, nested).collect()] == [0, 1, 2, 3, 8, 9, 10, 11]


def test_csv_of_several_files_without_names(spark, tmp_path):
    """A pattern over plain and gzip files, separated by white space, without a header, with a broken line; each row tells its file."""
    import gzip

    (tmp_path / "a.csv").write_text("1 2.5 x\n2 nothing y\n3 4.5 z\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write("4 1.5 w\n")
    got = files.read_csv(spark, f"{tmp_path}/*.csv*", "id long, v double, kind string", header=False, sep=" ")
    rows = sorted((r["id"], r["v"], r["kind"], r["file"].rsplit("/", 1)[1]) for r in got.collect())
    assert rows == [(1, 2.5, "x", "a.csv"), (3, 4.5, "z", "a.csv"), (4, 1.5, "w", "b.csv.gz")]


def test_routed_files_read_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k)) for k in range(20)], "k long, v double")
    wanted = spark.createDataFrame([(3,), (3,), (7,), (99,)], "k long")
    files.write_routed(rows, f"{tmp_path}/t", F.col("k") % 4)
    got = files.read_routed(spark, f"{tmp_path}/t", "k long, v double", wanted, "k", F.col("k") % 4)
    assert sorted(map(tuple, got.collect())) == [(3, 3.0), (7, 7.0)]
    none = files.read_routed(spark, f"{tmp_path}/missing", "k long, v double", wanted, "k", F.col("k") % 4)
    assert none.columns == ["k", "v"] and none.count() == 0


def test_time_column_is_found():
    assert expr.first_present(["id", "mjd", "MJD"]) == "MJD"
    with pytest.raises(ValueError):
        expr.first_present(["id"])


def test_samples_with_replacement_repeat_rows(spark):
    df = spark.createDataFrame([(k,) for k in range(10)], "k long")
    got = values(stats.drawn(df, 500, "k", "s"), "draw", "k")
    assert [g[0] for g in got] == list(range(500)) and {g[1] for g in got} == set(range(10))
    assert stats.drawn(df.where("k > 99"), 5, "k", "s").count() == 0


def test_spectrum_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    t, e = np.sort(rng.uniform(0, 30, 60)), rng.uniform(0.1, 0.3, 60)
    y = np.cos(2 * np.pi * 0.37 * t) + rng.normal(0, 0.2, 60)
    df = spark.createDataFrame([(1, *map(float, r)) for r in zip(t, y, e, strict=True)], "sourceid int, t double, mag double, emag double")
    f = [0.1, 0.37, 0.9]
    got = {r["f"]: r["power"] for r in series.spectrum(df, F.array(*map(F.lit, f))).collect()}
    w = e**-2 / (e**-2).sum()
    for x in f:
        design = np.column_stack([np.ones(60), np.cos(2 * np.pi * x * t), np.sin(2 * np.pi * x * t)]) * np.sqrt(w)[:, None]
        fit = design @ np.linalg.lstsq(design, np.sqrt(w) * y, rcond=None)[0]
        flat = (w * (y - (w * y).sum()) ** 2).sum()
        assert got[x] == pytest.approx(1 - ((np.sqrt(w) * y - fit) ** 2).sum() / flat, abs=1e-9)


def curves(spark, *parts):
    """Detections of several sources: (sourceid, times, values, error)."""
    rows = [(k, float(a), float(b), e) for k, t, y, e in parts for a, b in zip(t, y, strict=True)]
    return spark.createDataFrame(rows, "sourceid long, t double, mag double, emag double")


def dense_fit(t, y, e, f, terms, poly, ridge):
    """The same series by a design matrix."""
    w = e**-2.0
    y = y - (w * y).sum() / w.sum()
    u = 2 * (t - (t.max() + t.min()) / 2) / np.ptp(t)
    arg = 2 * np.pi * f * np.outer(t, np.arange(1, terms + 1))
    x = np.hstack([u[:, None] ** np.arange(poly), np.sin(arg), np.cos(arg)])
    a = (x * w[:, None]).T @ x
    damp = np.concatenate([np.zeros(poly), np.tile(ridge * w.sum() * np.arange(1, terms + 1) ** 2, 2)])
    coef = np.linalg.solve(a + np.diag(damp + np.abs(a).min() * 1e-4), x.T @ (w * y))
    return coef, (w * (y - x @ coef) ** 2).sum(), (w * y * y).sum()


def test_fits_from_sums_equal_design_matrices(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 40, 150))
    y = 3 + 0.5 * np.cos(2 * np.pi * t / 1.7) + 0.2 * np.cos(4 * np.pi * t / 1.7 + 1) + rng.normal(0, 0.02, 150)
    e = np.full(150, 0.02)
    rows = spark.createDataFrame([(1, *map(float, r)) for r in zip(t, 2 * (t - (t[0] + t[-1]) / 2) / np.ptp(t), y - y.mean(), e**-2.0, strict=True)], "sourceid long, t double, u double, y double, w double")
    about = spark.createDataFrame([(1, 0.01)], "sourceid long, ridge double")
    freqs = spark.createDataFrame([(1, 1 / 1.7, 2, 5), (1, 0.5 / 1.7, 2, 5)], "sourceid long, f double, low int, high int")
    for poly in (1, 3):
        got = fourier.fits(rows, freqs, about, poly).collect()
        assert {(r["f"], r["terms"]) for r in got} == {(f, k) for f in (1 / 1.7, 0.5 / 1.7) for k in (2, 3, 4, 5)}
        for r in got:
            coef, chi2, flat = dense_fit(t, y, e, r["f"], r["terms"], poly, 0.01)
            assert np.allclose(r["sines"] + r["cosines"], coef[poly:], atol=1e-7)
            assert r["chi2"] == pytest.approx(chi2, rel=1e-6) and r["flat"] == pytest.approx(flat, rel=1e-9)


def test_second_minimum_is_told():
    # two dips a turn, the second half as deep
    x = np.array([0.0, 0.0, 0.0, 0.2, 1.0])
    at, ratio, amplitude = fourier.second_minimum(x, np.eye(5) * 1e-8, 2, 1)
    m = 0.2 * np.cos(2 * np.pi * np.arange(500) / 500) + np.cos(4 * np.pi * np.arange(500) / 500)
    assert at == pytest.approx(0.5, abs=0.002) and ratio == pytest.approx((m[250] - m.min()) / np.ptp(m)) and amplitude == pytest.approx(np.ptp(m))
    assert fourier.second_minimum(x, np.eye(5), 2, 1)[:2] == (None, 1.0)
    assert fourier.second_minimum(np.zeros(5), np.eye(5), 2, 1) == (None, 1.0, 0.0)


def test_period_is_recovered(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 40, 150))
    y = 3 + 0.5 * np.cos(2 * np.pi * t / 1.7) + 0.2 * np.cos(4 * np.pi * t / 1.7 + 1) + rng.normal(0, 0.02, 150)
    lc = curves(spark, (1, t, y, 0.02), (2, t[:5], y[:5], 0.02), (3, np.ones(30), y[:30], 0.02), (4, [1.0, 2.0], [math.nan, math.inf], 0.02))
    out = {r["sourceid"]: r for r in fourier.periodic_features(lc.withColumn("amp_0", F.lit(1)), fourier.Settings()).collect()}
    one = out[1]
    # the grid of frequencies has steps of 0.005
    assert one["error"] is None and one["lsq_period"] == pytest.approx(1.7, rel=0.0025 * 1.7) and 0.9 < one["lsq_power"] <= 1
    assert one["amp_0"] == pytest.approx(0.5, abs=0.05) and one["log10_fap_ls"] < -10 and one["n_epochs"] == 150
    ridge = min(0.25, 2 / (np.ptp(np.percentile(y, [5, 95])) / 0.02) ** 3 / 1.5)
    coef, chi2, flat = dense_fit(t, y, np.full(150, 0.02), 1 / one["lsq_period"], one["lsq_nterms"], 2, ridge)
    assert one["lsq_power"] == pytest.approx(1 - chi2 / flat, abs=1e-8) and one["delta_loglik"] == pytest.approx((flat - chi2) / 2, rel=1e-8)
    near = [dense_fit(t, y, np.full(150, 0.02), 1 / one["lsq_period"] + d * 0.05 / np.ptp(t), one["lsq_nterms"], 2, ridge)[1] for d in (-1, 1)]
    assert one["lsq_period_error"] == pytest.approx(math.sqrt(2 / (sum(near) - 2 * chi2)) * 0.05 / np.ptp(t) * one["lsq_period"] ** 2, rel=1e-5)
    assert [out[k]["error"] for k in (2, 3, 4)] == ["too few points", "no frequency", "too few points"] and out[4]["n_epochs"] == 0
    assert fourier.periodic_features(lc.where("sourceid > 9")).count() == 0


def test_short_and_long_periods_are_found(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {1: (0.21, 30), 2: (90.0, 400)}
    for k, (period, span) in want.items():
        t = np.sort(rng.uniform(0, span, 200))
        y = 3 + 0.5 * np.cos(2 * np.pi * t / period) + rng.normal(0, 0.02, 200)
        rows += [(k, float(a), float(b), 0.02) for a, b in zip(t, y, strict=True)]
    out = fourier.periodic_features(spark.createDataFrame(rows, "sourceid long, t double, mag double, emag double")).collect()
    assert len(out) == 2
    for row in out:
        period, span = want[row["sourceid"]]
        # the grid's step is 1 / (5 span)
        assert row["error"] is None and abs(1 / row["ls_period"] - 1 / period) < 0.2 / span and 4 <= row["lsq_nterms"] <= 10


def test_yeo_johnson_finds_the_logarithm(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(np.expm1(v)),) for v in rng.normal(2, 0.5, 400)] + [(None,)], "x double")
    lam, _, _ = learning.fit_power(df, ["x"])["x"]
    assert abs(lam) < 0.25
    out = [r[0] for r in learning.power_transform(df, {"x": (0.0, 0.0, 1.0)}).collect()]
    assert out[-1] is None and out[0] == pytest.approx(math.log1p(df.first()[0]))


def test_knn_imputer_fills_from_neighbours(spark):
    rows = [(k, float(k), float(k)) for k in range(20)] + [(20, 10.2, None), (21, None, None)]
    got = {r[0]: r for r in imputing.knn_impute(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], "id", k=3).collect()}
    assert got[20]["b"] == pytest.approx(10.0) and math.isnan(got[21]["b"] if got[21]["b"] is not None else float("nan"))


def test_knn_imputer_takes_every_row_as_donor(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n, k = 6500, 3
    x = rng.normal(0, 1, (n, 3))
    x[rng.random((n, 3)) < 0.01] = np.nan
    x[:4] = [[np.nan, 1.0, 2.0]] * 3 + [[np.nan] * 3]
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    want = x.copy()
    for i in np.flatnonzero(np.isnan(x).any(axis=1) & ~np.isnan(x).all(axis=1)):
        both = ~np.isnan(x) & ~np.isnan(x[i])
        m = both.sum(axis=1)
        dist = np.where(m > 0, np.where(both, (x - x[i]) ** 2, 0).sum(axis=1) / np.maximum(m, 1), np.inf)
        for j in np.flatnonzero(np.isnan(x[i])):
            able = np.flatnonzero(~np.isnan(x[:, j]) & np.isfinite(dist))
            want[i, j] = x[able[np.argsort(dist[able], kind="stable")[:k]], j].mean()
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    for cells in (1 << 18, 200):
        monkeypatch.setattr(imputing, "BLOCK_CELLS", cells * 3)
        monkeypatch.setattr(imputing, "SLICE_CELLS", 10 * cells)
        monkeypatch.setattr(imputing, "MET", 2)
        out = {r["id"]: r for r in imputing.knn_impute(df, ["a", "b", "c"], "id", k).collect()}
        got = np.array([[np.nan if out[i][c] is None else out[i][c] for c in "abc"] for i in range(n)])
        assert len(out) == n and np.allclose(got, want, rtol=1e-12, atol=1e-12, equal_nan=True)


def test_forest_learns(spark):
    rng = np.random.default_rng(6)
    rows = [(k, "VAR" if k % 3 else "CONST", float((k % 3 > 0) * 2 + rng.normal()), float(rng.normal())) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, kind string, a double, b double")
    out = learning.cross_validated(df, lambda: learning.Forest(["a", "b"], "kind", "CONST", trees=10), "id", 3)
    assert out.count() == 300 and out.where("class = kind").count() > 230
    assert out.where("prob_var < 0 OR prob_var > 1 OR prob < 0.5").count() == 0


def test_sigma_clip_decides_as_sql_on_its_bound(spark):
    """Largest values that lie exactly five deviations off: the last bit of the percentiles decides."""
    import math

    import duckdb

    rng, rows, source = np.random.default_rng(3), [], 0
    while source < 300:
        n = int(rng.integers(8, 80))
        v = [*sorted(round(float(x), 2) for x in rng.uniform(10, 200, n - 1)), 1e4]
        at = lambda p: v[math.floor((n - 1) * p)] * (1 - (n - 1) * p % 1) + v[math.ceil((n - 1) * p)] * ((n - 1) * p % 1)  # noqa: E731, B023
        bound = at(0.5) + 2.5 * (at(0.84) - at(0.16))
        if bound > v[-2] and abs(bound - round(bound, 3)) < 1e-9:
            v[-1], source = round(bound, 3), source + 1
            rows += [(source, i, x) for i, x in enumerate(v)]
    made = pd.DataFrame(rows, columns=["sourceid", "i", "mag"])  # noqa: F841
    want = duckdb.sql("WITH p AS (SELECT sourceid, 0.5 * (quantile_cont(mag, 0.84) - quantile_cont(mag, 0.16)) AS s, median(mag) AS m FROM made GROUP BY 1) SELECT sourceid, i FROM made JOIN p USING (sourceid) WHERE CASE WHEN s > 0 THEN abs(mag - m) / s < 5 ELSE true END").fetchall()
    got = quality.sigma_clip(spark.createDataFrame(rows, "sourceid long, i int, mag double"), threshold=5.0).select("sourceid", "i").collect()
    assert 0 < len(rows) - len(want) < 300 and set(map(tuple, got)) == set(want)


def test_nearest_donors_by_products_are_the_exact_ones(monkeypatch):
    """Most rows are settled without a distance to every donor, with the same donors, ties and distances as by all distances."""
    rng, whole = np.random.default_rng(1), imputing._distances
    x, d = rng.normal(size=(60, 64)), rng.normal(size=(900, 64))
    d[:60] = x
    d[100:200] = d[200:300]
    x[rng.random(x.shape) < 0.03], d[rng.random(d.shape) < 0.03] = np.nan, np.nan
    tie, asked = rng.integers(0, 1 << 60, len(d)), []
    monkeypatch.setattr(imputing, "_distances", lambda a, b: asked.append(len(a)) or whole(a, b))
    got = sorted(zip(*[c.tolist() for c in imputing.nearest_donors(x, d, tie, 5)], strict=True))
    assert sum(asked) < 20
    dist, want = whole(x, d), []
    for i, j in np.argwhere(np.isnan(x)).tolist():
        able = [p for p in range(len(d)) if not np.isnan(d[p, j])]
        want += [(i, j, dist[i, p], tie[p], d[p, j]) for p in sorted(able, key=lambda p: (dist[i, p], tie[p], d[p, j]))[:5]]
    assert got == sorted(want)


def test_power_fit_merges_tasks(spark):
    """One row a task, feature and lambda reaches the sums: no row is multiplied by the grid; nulls, negative values and lambdas of 0 and 2 included."""
    from skyloom.operators.learning import _transformed, yeo_johnson

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.lognormal(3, 0.7, 400), -rng.random(30)])
    df = spark.createDataFrame([(float(v), None if k % 3 else float(v) + 2, k) for k, v in enumerate(x)], "a double, b double, k int").repartition(5, "k")
    for lam in (0.0, 0.5, 2.0, -1.2):
        got = df.select(yeo_johnson(F.col("a"), lam).alias("y"), "a").toPandas()
        assert np.allclose(got["y"], _transformed(got["a"].to_numpy(), lam))
    fitted = learning.fit_power(df, ["a", "b"])
    for c, own in (("a", x), ("b", x[::3] + 2)):
        lam, m, s = fitted[c]
        y = _transformed(own, lam)
        assert m == pytest.approx(y.mean()) and s == pytest.approx(y.std())
        score = lambda v: -len(own) / 2 * math.log(_transformed(own, v).var()) + (v - 1) * (np.sign(own) * np.log1p(np.abs(own))).sum()  # noqa: E731, B023
        assert score(lam) >= max(score(round(lam + k * 0.02, 6)) for k in (-1, 1))


def test_string_lengths_of_few_and_of_many_detections_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, float(t), float(v)) for k in (1, 2) for t, v in zip(rng.uniform(0, 30, 50), rng.normal(size=50).round(1), strict=True)] + [(3, 1.0, 2.0), (3, 2.0, 2.0), (4, None, 1.0)]
    lc, grid = spark.createDataFrame(rows, "sourceid long, t double, mag double"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: k / 10)
    few = series.string_length_search(lc, grid)
    assert "Window" not in few._jdf.queryExecution().executedPlan().toString()
    few = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(series, "LIGHT", 0)
    many = sorted(map(tuple, series.string_length_search(lc, grid).collect()))
    assert [r[:2] for r in few] == [r[:2] for r in many] and [r[0] for r in few] == [1, 2] and np.allclose([r[2] for r in few], [r[2] for r in many])
