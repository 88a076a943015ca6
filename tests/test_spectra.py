"""Spectra from time bins against the plain sums over detections."""

import numpy as np
import pytest

from skyloom.operators import series

LC = "sourceid long, t double, mag double, emag double"


def light_curve(rng, source, n, span, period=0.37):
    t = np.sort(rng.random(n)) * span + 50
    y = 15 + 0.4 * np.sin(2 * np.pi * t / period) + rng.normal(0, 0.05, n)
    return [(source, float(a), float(b), float(c)) for a, b, c in zip(t, y, rng.uniform(0.01, 0.1, n), strict=True)]


def both(df, f_min, f_max):
    spans, frequencies = series.own_grid(df.dropna(), f_min, f_max)
    plain = series.spectrum(spans, frequencies, extra=("_span",)).orderBy("sourceid", "f").toPandas()
    fast = series.fast_spectrum(df, f_min, f_max).orderBy("sourceid", "f").toPandas()
    return plain, fast


def test_bins_give_the_sums_over_detections(spark):
    """Few detections are summed directly, 6,000 by transforms; powers of ten days and of a hundred."""
    rng = np.random.default_rng(3)
    rows = light_curve(rng, 1, 60, 10) + light_curve(rng, 2, 6000, 10) + light_curve(rng, 3, 25, 100) + [(4, 1.0, 2.0, 0.1), (5, None, 1.0, 0.1), (6, 1.0, None, 0.1), (6, 2.0, 1.0, 0.1)]
    plain, fast = both(spark.createDataFrame(rows, LC), 0.1, 8.0)
    assert len(plain) == len(fast) and set(fast["sourceid"]) == {1, 2, 3}
    assert np.abs(plain["f"] - fast["f"]).max() < 1e-9
    assert np.abs(plain["power"] - fast["power"]).max() < 1e-8
    assert np.abs(plain["window_power"] - fast["window_power"]).max() < 1e-8


@pytest.mark.parametrize("n", [40, 4000])
def test_sums_of_bins_are_exact_to_rounding(n):
    """Moments of bins against every detection, by both ways of summing."""
    rng = np.random.default_rng(n)
    t, w = rng.random(n) * 7.0, rng.random(n) / n
    step, count = 1 / 35, 500
    cells = 1 << 13
    width = 1 / (step * cells)
    at = np.floor(t / width).astype(int)
    u = 2 * (t / width - at) - 1
    bins, where = np.unique(at, return_inverse=True)
    moments = np.stack([np.bincount(where, w * u**p) for p in range(series.TERMS)], axis=1)
    for f0, d in ((0.3, step), (0.6, 2 * step)):
        want = np.exp(2j * np.pi * np.outer(f0 + d * np.arange(count), t)) @ w
        (got,) = series._bin_sums(bins, moments, width, f0, d, count, cells)
        assert np.abs(got - want).max() < 1e-12


def test_ten_years_at_twenty_cycles_a_day(spark):
    """A source whose 365,000 frequencies and 3,000 detections would meet in a billion rows."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(light_curve(rng, 1, 3000, 3650.0, period=1 / 7.3), LC)
    best = series.fast_spectrum(df, 0.00066667, 20.0).orderBy("power", ascending=False).first()
    assert abs(best["f"] - 7.3) < 1e-4 and best["power"] > 0.9


def test_candidates_are_pruned_by_slow_ones(spark):
    """Against a loop that shrinks a list, test by test, in both orders of the slow frequencies."""
    rng = np.random.default_rng(6)
    rows = []
    for source in range(4):
        # nightly sampling over three years, a slow trend seen through it, and a fast period in two of the four
        t = np.sort(rng.integers(0, 1100, 220) + rng.normal(0.3, 0.02, 220))
        y = 14 + 0.5 * np.sin(2 * np.pi * t / (700 + 50 * source)) + (0.3 * np.sin(2 * np.pi * t / 0.73) if source % 2 else 0) + rng.normal(0, 0.05, len(t))
        rows += [(source, float(a), float(b), 0.05) for a, b in zip(t, y, strict=True)]
    lc = spark.createDataFrame(rows, LC)
    spec = series.fast_spectrum(lc, 0.00066667, 4.0).persist()
    got = {}
    for r in series.pruned_peaks(lc, spec).orderBy("sourceid", "peak").collect():
        got.setdefault(r["sourceid"], []).append(r["f"])
    cut = 0
    for source in range(4):
        s = spec.where(f"sourceid = {source}").orderBy("f").toPandas()
        p = s["power"].to_numpy()
        top = [i for i in range(1, len(p) - 1) if p[i] > p[i - 1] and p[i] > p[i + 1]]
        top = sorted(top, key=lambda i: -p[i])[:30]
        peaks = [(s["f"][i], p[i]) for i in top if not s["window_power"][i] > p[i]]
        t = np.array([r[1] for r in rows if r[0] == source])
        w = np.full(len(t), 1 / len(t))

        def window(f, t=t, w=w):
            a = 2 * np.pi * f * t
            c, q = np.cos(a), np.sin(a)
            m = np.array([[w @ (c * c), w @ (c * q)], [w @ (c * q), w @ (q * q)]])
            v = np.array([w @ c, w @ q])
            return v @ np.linalg.solve(m, v)

        for slow in (sorted(f for f, _ in peaks if f < 0.005), sorted((f for f, _ in peaks if f < 0.005), reverse=True)):
            left = list(peaks)
            for g in slow:
                for sign in (1, -1):
                    left = [(f, a) for f, a in left if f < 0.005 or not window(f + sign * g) > a]
            assert np.allclose(got[source], [f for f, _ in left])
        cut += len(peaks) - len(left)
    assert cut > 0
    aliases = series.pruned_peaks(lc, spec, alias=0.05, aliases=(0.73,)).where("abs(1 / f - 0.73) < 0.05")
    assert aliases.isEmpty()


def test_spectra_of_few_and_of_many_detections_agree(spark, monkeypatch):
    """Sums over detections and over time bins give the same powers and places; maxima alone are those of the whole spectrum."""
    rng = np.random.default_rng(4)
    rows = [(k, float(t), float(np.cos(2 * np.pi * t / 1.3) + rng.normal(0, 0.2)), 0.2) for k in (1, 2) for t in rng.uniform(0, 30, 80)] + [(3, 1.0, 1.0, 0.1)]
    lc = spark.createDataFrame(rows, "sourceid long, t double, mag double, emag double")
    read = lambda **more: series.fast_spectrum(lc, 0.01, 10.0, **more).orderBy("sourceid", "f").toPandas()
    few, tops = read(), read(maxima=True)
    monkeypatch.setattr(series, "LIGHT", 0)
    many = read()
    for c in ("sourceid", "f", "power", "window_power"):
        assert np.allclose(few[c], many[c], atol=1e-9)
    assert few["place"].equals(many["place"]) and set(few["sourceid"]) == {1, 2}
    assert np.allclose(tops, few[few["place"].notna()])
    first = few[few["place"] == 1].set_index("sourceid")["power"]
    assert (first == few.groupby("sourceid")["power"].max()).all()


def test_peaks_are_found_where_spectra_are_made(spark):
    """Whole spectra aren't sorted or moved to find their maxima."""
    lc = spark.createDataFrame([(1, k * 0.37, float(k % 5), 0.1) for k in range(40)], "sourceid long, t double, mag double, emag double")
    for df in (series.peaks(series.fast_spectrum(lc, 0.01, 5.0, maxima=True), 5), series.candidate_frequency(lc, 0.01, 5.0)):
        assert df.count() and "Window" not in df._jdf.queryExecution().executedPlan().toString()
