"""Periodic features of light curves: candidate frequencies, regularised Fourier series and the shape of the fitted curve.

Everything that reads detections is a grouped sum: the spectrum (``series``) and, for each frequency that is tried, the
trigonometric moments of a source up to twice the highest harmonic. A fit needs these moments alone (100 rows of sums at
most), so a source's detections are never gathered, however many there are. Python solves one small system per source,
frequency and number of harmonics; choices among fits are aggregates again.

Defined results: detections with a null, NaN or infinite time, value or error, or an error that isn't positive, don't count;
a source with fewer than ``min_points`` others, or without a frequency, gets one row with nulls and the reason in ``error``;
repeated detections count each; ties go to more harmonics, then the lower frequency; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.functions.expr import TWO_PI, finite
from skyloom.operators import curves, series
from skyloom.operators.storage import Scratch, durable

HARMONICS = 4
#: Detections of a source that are summed in one place.
RUN = 4096
#: Points of the phase grid on which a curve's shape is read.
GRID = 500


@dataclass(frozen=True)
class Settings:
    min_points: int = 21
    f_min: float = 0.02
    f_max: float = 2.0
    terms_max: int = 6
    terms_min: int = 2
    poly: int = 2
    #: Maxima of the spectrum among which the candidate is looked for.
    candidates: int = 30


#: The survey's limits; each source's grid follows from its baseline, in steps of 1 / (5 * span).
SURVEY = Settings(f_min=0.00066667, f_max=20.0, terms_max=10, terms_min=4, poly=3)


def moments(rows: DataFrame, freqs: DataFrame, poly: int) -> DataFrame:
    """Sums that fits at ``freqs`` (sourceid, f, high) need: sourceid, f and ``sums``, which has a run of numbers for each multiple 0 .. 2 high of f.

    ``rows`` has sourceid, t, u (time from -1 to 1), y (about the mean) and w. A run holds the sums of w times u^p cos (p below ``poly``),
    u^p sin, y cos, y sin, u^p (p from ``poly`` to 2 poly - 2), y u^p (p from 1) and y squared.
    """
    wanted = freqs.groupBy("sourceid").agg(F.collect_set("f").alias("fs"), F.max("high").alias("high"))
    each = rows.join(wanted, "sourceid").select("sourceid", "t", "u", "y", "w", "high", F.explode("fs").alias("f"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), 2 * F.col("high"))).alias("k"))
    angle = TWO_PI * F.col("f") * F.col("k") * F.col("t")
    each = each.select("sourceid", "f", "k", "u", "y", "w", (F.col("w") * F.cos(angle)).alias("c"), (F.col("w") * F.sin(angle)).alias("s"))
    c, s, u, y, w = (F.col(x) for x in "csuyw")
    power = lambda p: math.prod([u] * p, start=F.lit(1.0))
    terms = [c * power(p) for p in range(poly)] + [s * power(p) for p in range(poly)] + [y * c, y * s]
    terms += [w * power(p) for p in range(poly, 2 * poly - 1)] + [w * y * power(p) for p in range(1, poly)] + [w * y * y]
    sums = each.groupBy("sourceid", "f", "k").agg(*[F.sum(x).alias(f"m{i}") for i, x in enumerate(terms)])
    run = F.struct("k", F.array(*[f"m{i}" for i in range(len(terms))]).alias("m"))
    return sums.groupBy("sourceid", "f").agg(F.flatten(F.transform(F.sort_array(F.collect_list(run)), lambda x: x["m"])).alias("sums"))


def system(sums: np.ndarray, poly: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Normal matrix, right side and squared sum of the values, ordered as powers of u, sines, cosines."""
    m = sums.reshape(-1, 4 * poly + 1)
    cos, sin, (yc, ys) = m[:, :poly], m[:, poly : 2 * poly], m[:, 2 * poly : 2 * poly + 2].T
    high, rest = (len(m) - 1) // 2, m[0, 2 * poly + 2 :]
    plain, values = np.concatenate([cos[0], rest[: poly - 1]]), rest[poly - 1 : -1]
    k, p = np.arange(1, high + 1), np.arange(poly)
    apart, both, sign = np.abs(k[:, None] - k), k[:, None] + k, np.sign(k[:, None] - k)
    c, s = cos[:, 0], sin[:, 0]
    mixed = (s[both] + sign * s[apart]) / 2
    a = np.block([
        [plain[p[:, None] + p], sin[1 : high + 1].T, cos[1 : high + 1].T],
        [sin[1 : high + 1], (c[apart] - c[both]) / 2, mixed],
        [cos[1 : high + 1], mixed.T, (c[apart] + c[both]) / 2],
    ])
    return a, np.concatenate([yc[:1], values, ys[1 : high + 1], yc[1 : high + 1]]), float(rest[-1])


def solve(a: np.ndarray, b: np.ndarray, flat: float, terms: int, high: int, poly: int, ridge: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their covariance and chi-square of a series with ``terms`` harmonics, each damped with the square of its order."""
    k = np.arange(1, terms + 1)
    own = np.concatenate([np.arange(poly), poly - 1 + k, poly + high - 1 + k])
    plain, b = a[np.ix_(own, own)], b[own]
    damp = np.concatenate([np.zeros(poly), ridge * plain[0, 0] * k**2, ridge * plain[0, 0] * k**2])
    inverse = np.linalg.pinv(plain + np.diag(damp + np.abs(plain).min() * 1e-4), hermitian=True)
    x = inverse @ b
    return x, inverse, max(0.0, float(flat - 2 * b @ x + x @ plain @ x))


def second_minimum(x: np.ndarray, cov: np.ndarray, terms: int, poly: int) -> tuple[float | None, float, float]:
    """Phase of a significant second dip after the main one, the ratio of the depths (1 without), and the curve's amplitude."""
    angle = TWO_PI * np.outer(np.arange(GRID) / GRID, np.arange(1, terms + 1))
    waves = np.hstack([np.sin(angle), np.cos(angle)])
    m = waves @ x[poly:]
    wide = np.hstack([np.ones((GRID, 1)), waves])
    own = np.r_[0, poly : poly + 2 * terms]
    error = np.sqrt(np.maximum(0, ((wide @ cov[np.ix_(own, own)]) * wide).sum(axis=1)))
    m, error = np.roll(m, -m.argmax()), np.roll(error, -m.argmax())
    dip, rise = ((m > np.roll(m, 1)) & (m >= np.roll(m, -1))), np.flatnonzero((m < np.roll(m, 1)) & (m <= np.roll(m, -1)))
    amplitude, best = float(np.ptp(m)), None
    for i in np.flatnonzero(dip):
        if 0.35 < i / GRID < 0.65 and len(rise):
            sides = m[[rise[((rise - i) % GRID).argmin()], rise[((i - rise) % GRID).argmin()]]]
            if m[i] - sides.max() > 7 * error[i] and (best is None or m[i] - sides.mean() > best[0]):
                best = (m[i] - sides.mean(), i / GRID, (m[i] - m.min()) / amplitude)
    return (float(best[1]), float(best[2]), amplitude) if best else (None, 1.0, amplitude)


def faintest(x: np.ndarray, terms: int, poly: int) -> float:
    """Phase, from time zero, at which the curve has its greatest magnitude."""
    angle = TWO_PI * np.outer(np.arange(GRID) / GRID, np.arange(1, terms + 1))
    return float((np.hstack([np.sin(angle), np.cos(angle)]) @ x[poly:]).argmax() / GRID)


def fits(rows: DataFrame, freqs: DataFrame, about: DataFrame, poly: int, shape: bool = False) -> DataFrame:
    """Series at ``freqs`` (sourceid, f, low, high) with ``low`` to ``high`` harmonics each: sourceid, f, terms, chi2, flat (chi-square of the mean), sines, cosines and, with ``shape``, the second minimum, the phase of the first, and the curve itself (``coef``: level, sines, cosines; ``cov``)."""
    freqs = freqs.dropDuplicates(["sourceid", "f"])
    found = moments(rows, freqs, poly).join(freqs, ["sourceid", "f"]).join(about.select("sourceid", "ridge"), "sourceid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for one in batch.itertuples(index=False):
                a, b, flat = system(np.asarray(one.sums, float), poly)
                high = (len(a) - poly) // 2
                for terms in range(one.low, one.high + 1):
                    x, cov, chi2 = solve(a, b, flat, terms, high, poly, one.ridge)
                    own = np.r_[0, poly : poly + 2 * terms]
                    read = (*second_minimum(x, cov, terms, poly), faintest(x, terms, poly), x[own], list(cov[np.ix_(own, own)])) if shape else (None,) * 6
                    out.append((one.sourceid, one.f, terms, chi2, flat, x[poly : poly + terms], x[poly + terms :], *read))
            yield pd.DataFrame(out, columns="sourceid f terms chi2 flat sines cosines dip_phase depth_ratio amplitude min_phase coef cov".split())

    kind = dict(freqs.dtypes)["sourceid"]
    made = "f double, terms int, chi2 double, flat double, sines array<double>, cosines array<double>, dip_phase double, depth_ratio double, amplitude double, min_phase double, coef array<double>, cov array<array<double>>"
    return found.select("sourceid", "f", "low", "high", "ridge", "sums").mapInPandas(run, f"sourceid {kind}, {made}")


def ridges(rows: DataFrame, freqs: DataFrame, poly: int, grid: tuple[float, ...] = tuple(np.logspace(-5, 0, 50))) -> DataFrame:
    """The smoothing that generalised cross-validation prefers for a series at each of ``freqs`` (sourceid, f, high harmonics): sourceid, f, ridge, gcv, dof, and the whole curve of both over ``grid``.

    The score is (chi-square / n) over (1 - trace / n) squared, with the trace of the hat matrix. Both follow from ``moments``, so a grid
    of ridges reads detections once. Ties go to the greater ridge; a source with no more detections than coefficients gets nulls.
    """
    freqs = freqs.dropDuplicates(["sourceid", "f"])
    n = rows.groupBy("sourceid").agg(F.count("*").alias("n"))
    found = moments(rows, freqs, poly).join(n, "sourceid").select("sourceid", "f", "sums", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for one in batch.itertuples(index=False):
                a, b, flat = system(np.asarray(one.sums, float), poly)
                k = np.tile(np.arange(1, (len(a) - poly) // 2 + 1), 2)
                if one.n <= len(a):
                    out.append((one.sourceid, one.f, None, None, None, [], []))
                    continue
                # all ridges at once: one call for a stack of matrices
                damp = np.hstack([np.zeros((len(grid), poly)), np.outer(grid, a[0, 0] * k**2)]) + np.abs(a).min() * 1e-4
                inverse = np.linalg.pinv(a + damp[:, :, None] * np.eye(len(a)), hermitian=True)
                x, traces = inverse @ b, (inverse * a).sum(axis=(1, 2))
                chi2 = np.maximum(0.0, flat - 2 * x @ b + ((x @ a) * x).sum(axis=1))
                scores = chi2 / one.n / (1 - traces / one.n) ** 2
                best = len(grid) - 1 - int(np.argmin(scores[::-1]))
                out.append((one.sourceid, one.f, float(grid[best]), float(scores[best]), float(traces[best]), scores, traces))
            yield pd.DataFrame(out, columns="sourceid f ridge gcv dof scores traces".split())

    kind = dict(freqs.dtypes)["sourceid"]
    return found.mapInPandas(run, f"sourceid {kind}, f double, ridge double, gcv double, dof double, scores array<double>, traces array<double>")


def amplitudes() -> Column:
    return F.zip_with("sines", "cosines", lambda a, b: F.sqrt(a * a + b * b))


def _phase(at: str, k: int) -> Column:
    return F.atan2(-F.get(F.col(at)["sines"], F.lit(k)), F.get(F.col(at)["cosines"], F.lit(k)))


def _amplitude(at: str, k: int) -> Column:
    a, b = F.get(F.col(at)["sines"], F.lit(k)), F.get(F.col(at)["cosines"], F.lit(k))
    return F.sqrt(a * a + b * b)


def chosen(tried: DataFrame, about: DataFrame, settings: Settings) -> DataFrame:
    """One fit per source by AIC; series with a harmonic far beyond the data's range lose, but for that with the most harmonics."""
    best = tried.groupBy("sourceid", "terms").agg(F.min_by(F.struct("f", "chi2", "flat", "sines", "cosines"), F.struct("chi2", "f")).alias("a")).select("sourceid", "terms", "a.*")
    sane = (F.col("terms") == settings.terms_max) | (F.array_max(amplitudes()) <= 2 * F.col("spread"))
    rated = best.join(about.select("sourceid", "spread"), "sourceid").where(sane)
    return rated.groupBy("sourceid").agg(F.min_by(F.struct("f", "terms", "chi2", "sines", "cosines"), F.struct(F.col("chi2") + 4 * F.col("terms"), -F.col("terms"))).alias("a")).select("sourceid", "a.*")


def divisors(best: DataFrame, about: DataFrame, f_min: float) -> DataFrame:
    """Where a higher harmonic leads: its divisors as the fundamental, each with two neighbours."""
    lead = F.array_position(amplitudes(), F.array_max(amplitudes())).cast("int")
    parts = best.withColumn("lead", lead).where("lead > 1").select("sourceid", "f", "terms", "lead", F.explode(F.sequence(F.lit(1), F.col("lead") - 1)).alias("part")).where("lead % part = 0")
    near = parts.join(about.select("sourceid", "span"), "sourceid").withColumn("step", F.explode(F.array(F.lit(-0.2), F.lit(0.0), F.lit(0.2))))
    return near.select("sourceid", (F.col("f") * F.col("lead") / F.col("part") + F.col("step") / F.col("span")).alias("f"), F.col("terms").alias("low"), F.col("terms").alias("high")).where(F.col("f") > f_min)


def periodic_features(lc: DataFrame, settings: Settings = SURVEY) -> DataFrame:
    """One row per source of ``lc`` (sourceid, t, mag, emag); sources that can't be fitted say so in ``error``."""
    s, hold = settings, Scratch(lc.sparkSession)
    known = lc.select("sourceid", finite("t").alias("t"), finite("mag").alias("mag"), finite("emag").alias("emag")).where("sourceid IS NOT NULL AND t IS NOT NULL AND mag IS NOT NULL AND emag > 0")
    known = hold(known)
    w = 1 / (F.col("emag") * F.col("emag"))
    about = known.groupBy("sourceid").agg(
        F.count("*").alias("n"), F.stddev_pop("t").alias("dev"), (F.max("t") - F.min("t")).alias("span"), ((F.max("t") + F.min("t")) / 2).alias("mid"),
        (F.sum(w * F.col("mag")) / F.sum(w)).alias("mean"), F.percentile("mag", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.median("emag").alias("noise"),
    )
    spread = F.col("q")[1] - F.col("q")[0]
    ridge = F.least(F.lit(0.25), 2 / F.pow(F.greatest(spread / F.col("noise"), F.lit(1e-9)), 3) / (F.col("n") / 100))
    about = hold(about.select("*", spread.alias("spread"), ridge.alias("ridge")))
    whole = known.join(about.where((F.col("n") >= s.min_points) & (F.col("span") > 0)).select("sourceid"), "sourceid", "left_semi")
    found = hold(series.candidate_frequency(whole, s.f_min, s.f_max, s.min_points, top=s.candidates).withColumnRenamed("f", "ls_f"))
    rows = known.join(about.join(found, "sourceid", "left_semi").select("sourceid", "mid", "span", "mean", "n"), "sourceid")
    # a source's detections stay together up to RUN of them, so that sums are made before they move
    rows = series.dealt(rows.withColumn("_run", F.pmod(F.xxhash64("t"), F.ceil(F.col("n") / RUN))), "sourceid", "_run")
    rows = hold(rows.select("sourceid", "t", (2 * (F.col("t") - F.col("mid")) / F.col("span")).alias("u"), (F.col("mag") - F.col("mean")).alias("y"), w.alias("w")))

    f = F.col("ls_f")
    both = F.when(f / 2 > s.f_min, F.array(f / 2, f)).otherwise(F.array(f))
    first = found.select("sourceid", F.explode(both).alias("f"), F.lit(s.terms_min).alias("low"), F.lit(s.terms_max).alias("high"))
    best = hold(chosen(fits(rows, first, about, s.poly), about, s))
    others = fits(rows, divisors(best, about, s.f_min), about, s.poly).select("sourceid", "f", "terms", "chi2")
    better = best.select("sourceid", "f", "terms", "chi2").unionByName(others)
    best = hold(better.groupBy("sourceid").agg(F.min_by(F.struct("f", "terms"), F.struct("chi2", "f")).alias("a")).select("sourceid", "a.*").join(about.select("sourceid", "span"), "sourceid"))
    # the fit itself, two neighbours for the curvature, and twice the period
    at, step = F.col("f"), 0.05 / F.col("span")
    roles = best.select("sourceid", F.col("terms").alias("low"), F.col("terms").alias("high"), F.explode(F.create_map(F.lit("fit"), at, F.lit("below"), at - step, F.lit("above"), at + step, F.lit("double"), at / 2)).alias("role", "f"))
    roles = hold(roles)
    last = fits(rows, roles.drop("role"), about, s.poly, shape=True).join(roles.select("sourceid", "role", "f"), ["sourceid", "f"])
    last = last.groupBy("sourceid").pivot("role", ["fit", "below", "above", "double"]).agg(F.first(F.struct("f", "terms", "chi2", "flat", "sines", "cosines", "dip_phase", "depth_ratio", "amplitude", "min_phase", "coef", "cov")))
    last = hold(last)
    dips = last.select("sourceid", (1 / F.col("fit.f")).alias("period"), F.col("fit.min_phase").alias("min_phase"), F.col("fit.dip_phase").alias("second_phase"))
    dips = curves.depth_ratio(known, dips).select("sourceid", "peak_ratio_data")

    n, dev, chi2, flat, fit = F.col("n"), F.col("dev"), F.col("fit.chi2"), F.col("fit.flat"), F.col("fit.f")
    bend = (F.col("below.chi2") + F.col("above.chi2") - 2 * chi2) / F.pow(F.when(F.col("span") > 0, 0.05 / F.col("span")), 2)
    z = F.coalesce(1 - F.try_divide(chi2, flat), F.lit(0.0))
    bound = lambda p: F.coalesce(series.log10_false_alarm(p, n, dev, s.f_max), F.lit(-323.0))
    fitted = F.col("fit").isNotNull()
    dip = F.col("fit.dip_phase").isNotNull()
    every = lc.select("sourceid").where("sourceid IS NOT NULL").distinct().join(about, "sourceid", "left").join(found.drop("n", "log10_fap", "place"), "sourceid", "left").join(last, "sourceid", "left").join(dips, "sourceid", "left")
    every = every.withColumns({"z": z, "double": F.when(dip, F.col("fit")).otherwise(F.col("double"))})
    out = every.select(
        "sourceid",
        F.coalesce(n, F.lit(0)).cast("int").alias("n_epochs"),
        F.col("fit.terms").alias("lsq_nterms"),
        (1 / f).alias("ls_period"),
        F.col("power").alias("ls_power"),
        F.when(fitted, bound(F.col("power"))).alias("log10_fap_ls"),
        (1 / fit).alias("lsq_period"),
        F.when(bend <= 0, 0.0).otherwise(F.sqrt(2 / bend) / (fit * fit)).alias("lsq_period_error"),
        F.when(fitted, F.col("z")).alias("lsq_power"),
        F.when(fitted, bound(F.col("z"))).alias("log10_fap_lsq"),
        (0.5 * (flat - chi2)).alias("delta_loglik"),
        F.col("fit.amplitude").alias("model_amplitude"),
        F.col("fit.depth_ratio").alias("peak_ratio_model"),
        "peak_ratio_data",
        F.col("fit.dip_phase").alias("second_minimum_phase"),
        F.col("fit.min_phase").alias("minimum_phase"),
        F.transform("fit.coef", lambda v, k: v + F.when(k == 0, F.col("mean")).otherwise(0.0)).alias("fourier_coeffs"),
        F.col("fit.cov").alias("fourier_coeffs_cov"),
        *[_amplitude("fit", k).alias(f"amp_{k}") for k in range(HARMONICS)],
        *[_phase("fit", k).alias(f"phi_{k}") for k in range(HARMONICS)],
        *[_amplitude("double", k).alias(f"amp_double_{k}") for k in range(HARMONICS)],
        *[_phase("double", k).alias(f"phi_double_{k}") for k in range(HARMONICS)],
        F.when(fitted, dip).alias("significant_second_minimum"),
        F.when(F.coalesce(n, F.lit(0)) < s.min_points, "too few points").when(~fitted, "no frequency").alias("error"),
    )
    out = durable(out)
    hold.free()
    return out


def finalised(features: DataFrame, catalogue: DataFrame, colours: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """``features`` of the sources that ``catalogue`` has too, with its columns, colours and the features made of harmonics.

    ``colours`` names each colour's two magnitudes and its excess (columns of either table). Phase differences and ratios of amplitudes are made of phi_0 to phi_3 and
    amp_0 to amp_3, and of those of twice the period with ``_double``. A column of both tables keeps the features' value; the catalogue's is named with
    ``_catalogue``. Sources without a fit keep nulls; repeated catalogue rows repeat their source; a null id meets nothing.
    """
    taken = {c.lower() for c in features.columns} - {"sourceid"}
    other = catalogue.select(*[F.col(f"`{c}`").alias(f"{c}_catalogue" if c.lower() in taken else c) for c in catalogue.columns])
    both = features.join(other, "sourceid")
    made = {name: expr.dereddened(a, b, excess) for name, (a, b, excess) in (colours or {}).items()}
    for tail, mark in (("", ""), ("_double", "_double")):
        phases, sizes = ([f"{n}{tail}_{k}" for k in range(HARMONICS)] for n in ("phi", "amp"))
        for j in range(HARMONICS):
            for i in range(j + 1, HARMONICS):
                made[f"phi{i}_phi{j}{mark}"] = expr.principal_angle((j + 1) * F.col(phases[i]) - (i + 1) * F.col(phases[j]))
                made[f"a{j}_a{i}{mark}"] = expr.ratio(sizes[j], sizes[i])
    return both.withColumns(made)
