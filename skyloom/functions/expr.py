"""Scalar expressions: all are Columns that Catalyst plans and compiles."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Null for NaN and infinities, so that comparisons and aggregates skip them."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def log10_positive(c: str | Column) -> Column:
    """log10, null unless positive and finite."""
    c = finite(c)
    return F.when(c > 0, F.log10(c))


def signed_longitude(c: str | Column) -> Column:
    """0..360 to -180..180; exactly 180 stays."""
    c = col(c)
    return F.when(c > 180, c - 360).otherwise(c)


def full_longitude(c: str | Column) -> Column:
    c = col(c)
    return F.when(c < 0, c + 360).otherwise(c)


def principal_angle(c: str | Column) -> Column:
    return F.pmod(finite(c), F.lit(TWO_PI))


def phase(t: str | Column, period: str | Column, zero: str | Column = 0.0) -> Column:
    """Folded phase in [0, 1); null for a period that isn't positive."""
    zero = F.lit(zero) if isinstance(zero, float) else col(zero)
    period = col(period)
    return F.when(period > 0, F.pmod(col(t) - zero, period) / period)


def phase_differences(phases: list[str], prefix: str = "") -> list[Column]:
    """(j+1) phi_i - (i+1) phi_j, as principal angles, for all pairs j < i."""
    pairs = [(i, j) for j in range(len(phases)) for i in range(j + 1, len(phases))]
    return [principal_angle((j + 1) * F.col(phases[i]) - (i + 1) * F.col(phases[j])).alias(f"{prefix}phi{i}_phi{j}") for i, j in pairs]


def amplitude_ratios(amplitudes: list[str], prefix: str = "") -> list[Column]:
    pairs = [(i, j) for j in range(len(amplitudes)) for i in range(j + 1, len(amplitudes))]
    return [ratio(amplitudes[i], amplitudes[j]).alias(f"{prefix}a{i}_a{j}") for i, j in pairs]


def circle_features(angles: list[str]) -> list[Column]:
    """Cosine and sine of each angle, which lose the jump at a full turn."""
    return [f(F.col(a)).alias(f"{n}_{a}") for a in angles for n, f in (("cos", F.cos), ("sin", F.sin))]


def percentile_gaps(prefix: str, pairs: tuple[tuple[int, int], ...] = ((75, 25), (84, 16), (95, 5), (99, 1), (100, 0))) -> list[Column]:
    return [(F.col(f"{prefix}_p{a}") - F.col(f"{prefix}_p{b}")).alias(f"{prefix}_p{a}_p{b}") for a, b in pairs]


def clamp(c: str | Column, low: float, high: float, inside: float = 1e-9) -> Column:
    """Values beyond the bounds move just inside them."""
    c = col(c)
    return F.when(c <= low, low + inside).when(c >= high, high - inside).otherwise(c)


def log_complement(p: str | Column) -> Column:
    """log10(1 - p), null where p is 1 or more."""
    return log10_positive(1 - col(p))


def dereddened(a: str, b: str, excess: str) -> Column:
    return F.col(a) - F.col(b) - F.col(excess)


def relation_distance(mag: str, colour: str, period: str, colour_term: float, slope: float, zero: float) -> Column:
    """Distance in kpc of a period-luminosity relation."""
    return F.pow(F.lit(10.0), 0.2 * (F.col(mag) - colour_term * F.col(colour) + slope * log10_positive(period) + zero) - 2)


#: Slope, zero point and metallicity term in J and in Ks, and the modulus at which the zero points hold.
RELATIONS = {
    "RRab": ((-2.50, 17.699, 0.0), (-2.84, 17.36, 0.0), 18.477),
    "RRcd": ((-2.53, 17.241, 0.0), (-2.98, 16.86, 0.0), 18.477),
    "EW": ((-6.84, -0.039, 0.0), (-5.94, 0.0, 0.0), 0.0),
}
METAL_RELATIONS = {
    "RRab": ((-2.45, 17.888, 0.121), (-2.80, 17.547, 0.114), 18.477),
    "RRcd": ((-2.53, 17.225, -0.01), (-2.99, 16.85, 0.011), 18.477),
}


def class_distance(kind: str, j: str, k: str, period: str, relations: dict = RELATIONS, colour_term: float = 0.428, metal: str | None = None) -> Column:
    """Distance in kpc by the relation of each row's class, free of reddening; null for classes without one and periods that aren't positive.

    With ``metal`` (a column) the metallicity term counts; a null there gives null.
    """
    free = lambda a, b: b - colour_term * (a - b)
    seen = free(F.col(j), F.col(k))
    out = F.lit(None).cast("double")
    for name, (own, other, modulus) in relations.items():
        slope, zero, rich = (free(a, b) for a, b in zip(own, other, strict=True))
        expected = slope * log10_positive(period) + zero + (rich * F.col(metal) if metal else 0.0)
        out = F.when(F.col(kind) == name, F.pow(F.lit(10.0), 0.2 * (seen - expected + modulus) - 2)).otherwise(out)
    return out


def on_plane(distance: str, lon: str, lat: str) -> list[Column]:
    lon, lat = F.radians(lon), F.radians(lat)
    return [(F.col(distance) * F.cos(lon) * F.cos(lat)).alias("x"), (F.col(distance) * F.sin(lon) * F.cos(lat)).alias("y")]


def colour_error(sigma_a: str, sigma_b: str, colour: str, term: float, rel: float) -> Column:
    """Error of a - term * colour with independent errors and a relative error of the term."""
    return F.sqrt(F.pow(F.col(sigma_a), 2) * (1 + term) ** 2 + term**2 * F.pow(F.col(sigma_b), 2) + rel**2 * F.pow(F.col(colour), 2))


def decimal_year(ts: str | Column) -> Column:
    """Calendar year with the fraction of the year that has passed."""
    ts = col(ts).cast("timestamp_ntz")
    start = F.make_date(F.year(ts), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    end = F.make_date(F.year(ts) + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    span = lambda a, b: F.timestamp_diff("SECOND", a, b).cast("double")
    return F.year(ts) + span(start, ts) / span(start, end)


def corrected_period(period: str, kind: str, amplitudes: list[str], tolerance: float = 1.0) -> Column:
    """Detached and ellipsoidal systems double a period whose first harmonic leads; others are divided by their strongest harmonic; contact systems double then."""
    best = F.array_position(F.array(*amplitudes), F.array_max(F.array(*amplitudes)))
    doubled = F.when(F.col(amplitudes[0]) > tolerance * F.col(amplitudes[1]), 2 * F.col(period)).otherwise(F.col(period))
    divided = F.col(period) / best
    return F.when(F.col(kind).isin("EA/EB", "Ell"), doubled).when(F.col(kind) == "EW", 2 * divided).otherwise(divided)


def not_alias(period: str, width: float = 2.5e-4, sidereal: float = 0.99726957, year: float = 365.25) -> Column:
    """True unless the frequency lies near a harmonic of the sidereal day or its yearly side lobes."""
    f = 1 / F.col(period)
    near = [F.abs(f - (k / sidereal + s / year)) < width for k in range(2, 10) for s in (-1, 0, 1)]
    out = near[0]
    for n in near[1:]:
        out = out | n
    return ~F.coalesce(out, F.lit(False))


def series_value(coefficients: list[tuple[str, str]], phase_: Column) -> Column:
    """Sum of amplitude * cos(2 pi n phase + phi) over (amplitude, phi) columns."""
    out = F.lit(0.0)
    for n, (a, p) in enumerate(coefficients, 1):
        out = out + F.col(a) * F.cos(TWO_PI * n * phase_ + F.col(p))
    return out


def log_amplitude(n_observations: str, flux_over_error: str) -> Column:
    """log10 of the scatter that a mean flux's error implies; null unless both are positive."""
    return log10_positive(ratio(F.sqrt(F.col(n_observations)), flux_over_error))


def linear_mix(base: str, colour: str, slope: float, zero: float = 0.0) -> Column:
    """Magnitude in another system: base + slope * colour + zero."""
    return F.col(base) + slope * F.col(colour) + zero


def parallax_residual(parallax: str, distance: str, shift: float) -> Column:
    """Parallax minus its zero point minus the one that a distance in kpc implies."""
    return F.col(parallax) - shift - F.try_divide(F.lit(1.0), F.col(distance))


def strip_weight(lon: str, inner: float, wide: float, narrow: float) -> Column:
    """Height of the surveyed strip at a longitude: wide towards the centre, narrow elsewhere."""
    return F.when(F.abs(signed_longitude(lon)) < inner, wide).otherwise(narrow)


def translated_id(c: str, separator: str, prefixes: dict[str, str]) -> Column:
    """prefix-of-the-head + tail of an id cut at ``separator``; null for unknown heads."""
    parts = F.split(F.col(c), separator)
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return F.concat(table[parts[0]], parts[1])


def beyond_tolerance(a: str | Column, b: str | Column, tolerance: float) -> Column:
    """Whether a differs from b by more than a share of b; null where either is null or b is 0."""
    return F.abs(ratio(a, b) - 1) > tolerance


def first_present(columns: list[str], names: tuple[str, ...] = ("HJD", "JD", "MJD", "mjd", "mjdobs")) -> str:
    """The first of ``names`` among the columns; an error names both if there is none."""
    for name in names:
        if name in columns:
            return name
    raise ValueError(f"none of {names} in {columns}")


def inserted(df: DataFrame, name: str, value: Column, at: int) -> DataFrame:
    """``df`` with a new column at a position."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*columns[:at], value.alias(name), *columns[at:])


def tidied(df: DataFrame, without: str = "", pattern: str = "", to: str = "", suffix: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lower-case names, columns whose name contains ``without`` dropped, a pattern replaced in names, a suffix on all but ``keep``."""
    names = {}
    for c in df.columns:
        if not (without and without in c):
            new = re.sub(pattern, to, c.lower()) if pattern else c.lower()
            names[c] = new if new in keep else new + suffix
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def between(a: Column, b: Column, share: Column) -> Column:
    """a (1 - share) + b share with the first product unrounded (what a fused multiply-add gives): its rounding error and the sum's are added back."""
    def one(v: Column) -> Column:
        a, b, share = v["a"], v["b"], v["d"]
        halves = lambda x: (lambda big: (big - (big - x), x - (big - (big - x))))(x * F.lit(134217729.0))
        rest = 1 - share
        p, q, (ah, al), (rh, rl) = a * rest, b * share, halves(a), halves(rest)
        lost = al * rl - (((p - ah * rh) - al * rh) - ah * rl)
        total = p + q
        back = total - p
        exact = total + (((p - (total - back)) + (q - back)) + lost)
        return F.when(share == 0, a).when(F.isnan(exact), total).otherwise(exact)

    # the parts are bound once, as written out they would be too long to compile
    return F.get(F.transform(F.array(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), share.alias("d"))), one), F.lit(0))
