"""Ordered analytics of light curves: folding, gaps, spectra and peaks, all relational."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.expr import phase, ratio
from skyloom.operators.storage import durable

#: Detections up to which a source's are summed or folded as they are, in one row.
LIGHT = 512


def phase_gaps(lc: DataFrame, period: str | Column, key: str = "sourceid", time: str = "t") -> DataFrame:
    """Largest gap of the folded times, the wrap-around gap included, over the period; its distance from the mean gap in deviations."""
    folded = lc.withColumn("_p", phase(time, period))
    order = Window.partitionBy(key).orderBy("_p")
    ends = Window.partitionBy(key)
    gap = F.coalesce(F.lead("_p").over(order) - F.col("_p"), F.min("_p").over(ends) + 1 - F.col("_p"))
    g = folded.withColumn("_gap", gap).groupBy(key).agg(F.max("_gap").alias("max_phase_lag"), F.avg("_gap").alias("_m"), F.stddev_pop("_gap").alias("_s"))
    return g.select(key, "max_phase_lag", F.abs(ratio(F.col("max_phase_lag") - F.col("_m"), "_s")).alias("phase_lag_mean"))


def string_length(lc: DataFrame, period: str | Column, key: str = "sourceid", time: str = "t", value: str = "mag") -> DataFrame:
    """Length of the closed line through the folded points, values scaled to their range."""
    w = Window.partitionBy(key)
    scaled = lc.withColumn("_p", phase(time, period)).withColumn("_v", ratio(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)))
    order = w.orderBy("_p", "_v")
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dp = F.coalesce(F.lead("_p").over(order), F.first("_p").over(first) + 1) - F.col("_p")
    dv = F.coalesce(F.lead("_v").over(order), F.first("_v").over(first)) - F.col("_v")
    return scaled.withColumn("_l", F.sqrt(dp * dp + dv * dv)).groupBy(key).agg(F.sum("_l").alias("string_length"))


def _shortest(t: np.ndarray, v: np.ndarray, fs: np.ndarray) -> tuple[float, float] | None:
    """Frequency and length of the shortest line of one source, the least frequency of equal ones; none where values don't vary."""
    low, high = v.min(), v.max()
    if not high > low:
        return None
    v, best = (v - low) / (high - low), None
    for f in fs.tolist():
        p = np.mod(t, 1 / f) / (1 / f)
        order = np.lexsort((v, p))
        p, own = p[order], v[order]
        dp, dv = np.diff(p, append=p[0] + 1), np.diff(own, append=own[0])
        length = float(np.sqrt(dp * dp + dv * dv).sum())
        if best is None or (length, f) < best:
            best = (length, f)
    return best and (best[1], best[0])


def string_length_search(lc: DataFrame, frequencies: Column, key: str = "sourceid", time: str = "t", value: str = "mag") -> DataFrame:
    """key, f, string_length: of ``frequencies`` (an array expression without columns) the one with the shortest line, the least of equal ones.

    A source of up to LIGHT detections is one row, folded at all frequencies in one place. Of others each frequency is a group of its own, so they are
    dealt to all tasks. Sources whose values don't vary have no length and no row.
    """
    rows = lc.select(key, F.col(time).alias("t"), F.col(value).alias("v")).where("t IS NOT NULL AND v IS NOT NULL")
    number = durable(rows.groupBy(key).agg(F.count("*").alias("_n")))
    schema = f"{key} {lc.schema[key].dataType.simpleString()}, f double, string_length double"
    parts = int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, seen, fs = np.cumsum(batch.column("n").to_numpy()), batch.column("seen").flatten(), batch.column("fs")
            t, v = seen.field("t").to_numpy(), seen.field("v").to_numpy()
            found = [_shortest(t[lo:hi], v[lo:hi], fs[r].values.to_numpy()) for r, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))]
            able = [r for r, x in enumerate(found) if x]
            f, length = zip(*[found[r] for r in able], strict=True) if able else ((), ())
            yield pa.record_batch([batch.column(key).take(pa.array(able, pa.int32())), pa.array(f, pa.float64()), pa.array(length, pa.float64())], names=[key, "f", "string_length"])

    light = rows.join(number.where(F.col("_n") <= LIGHT), key).groupBy(key).agg(F.collect_list(F.struct("t", "v")).alias("seen"))
    out = light.repartition(parts, key).select(key, "seen", F.size("seen").alias("n"), frequencies.alias("fs")).mapInArrow(run, schema)
    heavy = number.where(F.col("_n") > LIGHT)
    if heavy.isEmpty():
        return out
    each = dealt(rows.join(heavy, key), key, "t").withColumn("_f", F.explode(frequencies)).withColumn("_k", F.struct(key, "_f"))
    lengths = string_length(each, 1 / F.col("_f"), "_k", "t", "v").where("string_length IS NOT NULL")
    some = lengths.groupBy(F.col("_k")[key].alias(key)).agg(F.min(F.struct("string_length", F.col("_k")["_f"].alias("f"))).alias("a")).select(key, "a.f", "a.string_length")
    return out.unionAll(some)


def nearest_in_phase(lc: DataFrame, period: str | Column, k: int, key: str = "sourceid", time: str = "t", value: str = "mag", error: str = "emag", id_col: str = "event_id") -> DataFrame:
    """Each detection with the weighted mean of the k others of its source that are nearest in circular phase.

    The k nearest on a circle lie among the k before and the k after in phase order, so a window replaces the self-join.
    """
    folded = lc.withColumn("_p", phase(time, period))
    carry = F.struct(F.col("_p").alias("p"), F.col(id_col).alias("id"), F.col(value).alias("v"), F.col(error).alias("e"))
    turns = folded.withColumn("_turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_at", F.col("_p") + F.col("_turn"))
    order = Window.partitionBy(key).orderBy("_at", id_col)
    near = turns.withColumn("_n", F.concat(F.collect_list(carry).over(order.rowsBetween(-k, -1)), F.collect_list(carry).over(order.rowsBetween(1, k)))).where("_turn = 0")
    turn = lambda x: F.abs(x["p"] - F.col("_p"))
    gaps = F.transform("_n", lambda x: F.struct(F.least(turn(x), 1 - turn(x)).alias("d"), x["id"].alias("id"), x["v"].alias("v"), x["e"].alias("e")))
    own = F.array_distinct(F.filter(gaps, lambda x: x["id"] != F.col(id_col)))
    best = F.slice(F.array_sort(own), 1, k)
    add = lambda f: F.aggregate("_b", F.lit(0.0), lambda a, x: a + f(x))
    out = near.withColumn("_b", best).withColumn("local_mean", F.try_divide(add(lambda x: x["v"] / (x["e"] * x["e"])), add(lambda x: 1 / (x["e"] * x["e"]))))
    return out.select(key, id_col, F.col("_p").alias("phase"), F.col(value), "local_mean")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` over all shuffle partitions, few as they are: each becomes many in the next step. The number is given, so that adaptive execution keeps it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def spectrum(lc: DataFrame, frequencies: Column, key: str = "sourceid", time: str = "t", value: str = "mag", error: str = "emag", window: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Lomb-Scargle power (floating mean, standard norm) of every source at every frequency, or the window's with ``window``.

    ``frequencies`` is an array expression, which may use ``extra`` columns; ``window_power`` is that of the sampling. One shuffle by source.
    """
    w = F.col("w")
    rows = lc.select(key, F.col(time).alias("t"), F.col(value).alias("y"), (1 / (F.col(error) * F.col(error))).alias("w"), *extra).where("y IS NOT NULL AND w IS NOT NULL")
    # sums by source are joined: a window would gather all detections of a source in one task
    rows = rows.join(rows.groupBy(key).agg(F.sum("w").alias("_w"), (F.sum(w * F.col("y")) / F.sum("w")).alias("_mean")), key)
    rows = rows.withColumns({"w": w / F.col("_w"), "y": F.lit(1.0) if window else F.col("y") - F.col("_mean")})
    each = dealt(rows, key, "t").withColumn("f", F.explode(frequencies))
    angle = 2 * math.pi * F.col("f") * F.col("t")
    each = each.withColumns({"c": F.cos(angle), "s": F.sin(angle)})
    c, s, y = F.col("c"), F.col("s"), F.col("y")
    sums = each.groupBy(key, "f").agg(
        F.sum(w * c).alias("C"), F.sum(w * s).alias("S"), F.sum(w * y * y).alias("YY"), F.sum(w * y * c).alias("YC"), F.sum(w * y * s).alias("YS"), F.sum(w * c * c).alias("CC"), F.sum(w * c * s).alias("CS")
    )
    return _power(sums, key, window)


def _power(sums: DataFrame, key: str, window: bool = False) -> DataFrame:
    """Power and the sampling's own power from weighted sums of cosines and sines (C, S), with the values (YC, YS, YY) and of their products (CC, CS)."""
    shift = 0.0 if window else 1.0
    cc, ss, cs = F.col("CC") - shift * F.col("C") * F.col("C"), 1 - F.col("CC") - shift * F.col("S") * F.col("S"), F.col("CS") - shift * F.col("C") * F.col("S")
    top = ss * F.col("YC") * F.col("YC") + cc * F.col("YS") * F.col("YS") - 2 * cs * F.col("YC") * F.col("YS")
    seen = (1 - F.col("CC")) * F.col("C") * F.col("C") + F.col("CC") * F.col("S") * F.col("S") - 2 * F.col("CS") * F.col("C") * F.col("S")
    seen = F.try_divide(seen, F.col("CC") * (1 - F.col("CC")) - F.col("CS") * F.col("CS"))
    return sums.select(key, "f", F.try_divide(top, F.col("YY") * (cc * ss - cs * cs)).alias("power"), seen.alias("window_power"))


#: Taylor terms about the centre of a time bin; angles from there are at most one, so what is left out is below 1 / 17!.
TERMS = 17


def _bin_sums(at: np.ndarray, sums: np.ndarray, width: float, f0: float, step: float, n: int, cells: int) -> list[np.ndarray]:
    """Sums of e^(2 pi i f t) times each weight for f = f0 + k step (k < n), from Taylor moments of bins ``at`` (rows of ``sums``, TERMS columns a weight) of ``width``.

    With ``step * width = j / cells`` for a whole j. Few bins are summed as they are, many by one transform of ``cells`` cells for each moment.
    """
    f = f0 + step * np.arange(n)
    middle, columns = (at + 0.5) * width, sums.shape[1]
    if 24 * len(at) * n < TERMS * cells * math.log2(cells):
        parts = np.zeros((columns, n), np.complex128)
        for lo in range(0, len(at), rows := max(1, (1 << 20) // n)):
            angle = 2 * math.pi * np.outer(middle[lo : lo + rows], f)
            parts.real += sums[lo : lo + rows].T @ np.cos(angle)
            parts.imag += sums[lo : lo + rows].T @ np.sin(angle)
        moment = lambda c: parts[c]
    else:
        stride = round(step * width * cells)
        start, half = np.exp(2j * math.pi * f0 * middle), np.exp(1j * math.pi * stride / cells * np.arange(n))

        def moment(c: int) -> np.ndarray:
            held = np.zeros(cells, np.complex128)
            held[at] = sums[:, c] * start
            return np.fft.ifft(held, norm="forward")[: stride * n : stride] * half

    turn, term = 1j * math.pi * f * width, np.ones(n, np.complex128)
    out = [np.zeros(n, np.complex128) for _ in range(columns // TERMS)]
    for p in range(TERMS):
        for j, total in enumerate(out):
            total += term * moment(j * TERMS + p)
        term = term * turn / (p + 1)
    return out


def _direct_sums(t: np.ndarray, weights: tuple[np.ndarray, ...], f0: float, step: float, n: int) -> list[np.ndarray]:
    """As ``_bin_sums`` from detections themselves: k = a block + b, so that a sum is a product of two matrices with a turn for each a and each b."""
    block = math.isqrt(n - 1) + 1
    coarse = np.exp(2j * math.pi * np.outer(t, f0 + step * block * np.arange(-(-n // block))))
    fine = np.exp(2j * math.pi * step * np.outer(t, np.arange(block)))
    return [((coarse * w[:, None]).T @ fine).ravel()[:n] for w in weights]


def _powers(one: np.ndarray, values: np.ndarray, twice: np.ndarray, yy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_power``, in one source: both powers (nan where there is none) and each local maximum's place by power (0 elsewhere)."""
    c, s, yc, ys, c2, cs = one.real, one.imag, values.real, values.imag, (1 + twice.real) / 2, twice.imag / 2
    cc, ss, both = c2 - c * c, 1 - c2 - s * s, cs - c * s
    top, under = ss * yc * yc + cc * ys * ys - 2 * both * yc * ys, yy * (cc * ss - both * both)
    seen, below = (1 - c2) * c * c + c2 * s * s - 2 * cs * c * s, c2 * (1 - c2) - cs * cs
    with np.errstate(divide="ignore", invalid="ignore"):
        power, seen = np.where(under != 0, top / under, np.nan), np.where(below != 0, seen / below, np.nan)
    place = np.zeros(len(power), np.int32)
    at = 1 + np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] > power[2:]))
    place[at[np.argsort(-power[at], kind="stable")]] = np.arange(1, len(at) + 1)
    return power, seen, place


def fast_spectrum(lc: DataFrame, f_min: float, f_max: float, oversampling: int = 5, key: str = "sourceid", time: str = "t", value: str = "mag", error: str = "emag", maxima: bool = False) -> DataFrame:
    """As ``spectrum`` on each source's ``own_grid``: key, f, power, window_power and place (of a local maximum among all, from 1, equal ones by f; else null), of maxima alone with ``maxima``.

    A source of up to LIGHT detections is one row of these. Others are summed over time bins, so detections meet no frequency:
    bins are so narrow that no angle turns by more than one about a bin's centre, at twice the highest frequency; a bin keeps TERMS Taylor
    moments of weight and of weighted value. A source's bins, a fixed number for its baseline and frequencies however many its
    detections are, are turned into all of its sums in one call. Sources without a baseline have no rows.
    """
    rows = lc.select(key, F.col(time).alias("t"), F.col(value).alias("y"), (1 / (F.col(error) * F.col(error))).alias("w")).where("t IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL")
    w = F.col("w")
    about = rows.groupBy(key).agg(F.sum("w").alias("_w"), (F.sum(w * F.col("y")) / F.sum("w")).alias("_mean"), F.min("t").alias("_from"), (F.max("t") - F.min("t")).alias("span"), F.count("*").alias("_count")).where("span > 0")
    about = durable(about.withColumn("n", F.round((f_max - f_min) * oversampling * F.col("span")).cast("long") + 1))
    scaled = lambda own: rows.join(own, key).withColumns({"w": w / F.col("_w"), "y": F.col("y") - F.col("_mean")})
    kind = lc.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, f double, power double, window_power double, place int"
    # few rows become whole spectra; a number of parts of its own, else the exchange counts as done by the sums below, which adaptive execution joins
    parts = int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1

    def told(name: pa.Scalar, span: float, one: np.ndarray, values: np.ndarray, twice: np.ndarray, yy: float) -> list:
        power, seen, place = _powers(one, values, twice, yy)
        at = np.flatnonzero(place) if maxima else np.arange(len(power))
        f = f_min + at / (oversampling * span)
        return [pa.repeat(name, len(at)), pa.array(f), pa.array(power[at], from_pandas=True), pa.array(seen[at], from_pandas=True), pa.array(place[at], mask=place[at] == 0)]

    names = [key, "f", "power", "window_power", "place"]

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, ns, ends = (batch.column(c).to_numpy() for c in ("span", "n", "ends"))
            seen = batch.column("seen").flatten()
            t, w, y = (seen.field(c).to_numpy() for c in "twy")
            for r, (span, n, hi) in enumerate(zip(spans.tolist(), ns.tolist(), np.cumsum(ends).tolist(), strict=True)):
                own = slice(hi - int(ends[r]), hi)
                step, wy = 1 / (oversampling * span), w[own] * y[own]
                one, values = _direct_sums(t[own], (w[own], wy), f_min, step, n)
                (twice,) = _direct_sums(t[own], (w[own],), 2 * f_min, 2 * step, n)
                yield pa.record_batch(told(batch.column(key)[r], span, one, values, twice, float(wy @ y[own])), names=names)

    one = F.struct((F.col("t") - F.col("_from")).alias("t"), "w", "y")
    gathered = scaled(about.where(F.col("_count") <= LIGHT)).groupBy(key, "span", "n").agg(F.collect_list(one).alias("seen")).withColumn("ends", F.size("seen"))
    out = gathered.repartition(parts, key).mapInArrow(light, schema)
    heavy = about.where(F.col("_count") > LIGHT)
    if heavy.isEmpty():
        return out

    u = F.col("u")
    cells = F.pow(F.lit(2.0), F.ceil(F.log2(2 * math.pi * (f_min * oversampling * F.col("span") + F.col("n"))))).cast("long")
    rows = scaled(heavy.withColumn("cells", cells).withColumn("width", oversampling * F.col("span") / F.col("cells")))
    place = (F.col("t") - F.col("_from")) / F.col("width")
    rows = rows.withColumn("bin", F.floor(place).cast("long"))
    rows = rows.withColumn("u", 2 * (place - F.col("bin")) - 1)
    # powers of u by halving, so that no expression is deep
    rows = rows.withColumns({"u2": u * u, "u3": u * u * u}).withColumn("u4", F.col("u2") * F.col("u2")).withColumn("u8", F.col("u4") * F.col("u4")).withColumn("u12", F.col("u8") * F.col("u4")).withColumn("u16", F.col("u8") * F.col("u8"))
    small_, large = [F.lit(1.0), u, F.col("u2"), F.col("u3")], [F.lit(1.0), F.col("u4"), F.col("u8"), F.col("u12"), F.col("u16")]
    power = lambda p: large[p // 4] * small_[p % 4]
    wy = w * F.col("y")
    of = F.struct("span", "n", "cells", "width").alias("of")
    binned = rows.groupBy(key, of, "bin").agg(*[F.sum(w * power(p)).alias(f"w{p}") for p in range(TERMS)], *[F.sum(wy * power(p)).alias(f"y{p}") for p in range(TERMS)], F.sum(wy * F.col("y")).alias("yy"))
    flat = binned.select(key, "of.*", "bin", "yy", F.array(*[f"w{p}" for p in range(TERMS)]).alias("ws"), F.array(*[f"y{p}" for p in range(TERMS)]).alias("ys"))

    def run(t: pa.Table) -> pa.Table:
        span, n, cells, width = (t.column(c)[0].as_py() for c in ("span", "n", "cells", "width"))
        matrix = lambda c: t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, TERMS)
        at, ws, ys, step = t.column("bin").to_numpy(), matrix("ws"), matrix("ys"), 1 / (oversampling * span)
        one, values = _bin_sums(at, np.hstack([ws, ys]), width, f_min, step, n, cells)
        (twice,) = _bin_sums(at, ws, width, 2 * f_min, 2 * step, n, cells)
        return pa.table(told(t.column(key)[0], span, one, values, twice, t.column("yy").to_numpy().sum()), names=names)

    return out.unionAll(flat.repartition(parts, key).groupBy(key).applyInArrow(run, schema))


def _maxima(spec: DataFrame, key: str) -> DataFrame:
    """Local maxima (above both neighbours) of each spectrum with their place by power, equal ones by f; ``fast_spectrum`` has told them."""
    if "place" in spec.columns:
        return spec.where("place IS NOT NULL")
    order = Window.partitionBy(key).orderBy("f")
    local = spec.withColumns({"_a": F.lag("power").over(order), "_b": F.lead("power").over(order)}).where("power > _a AND power > _b").drop("_a", "_b")
    return local.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("power"), "f")))


def own_grid(lc: DataFrame, f_min: float, f_max: float, oversampling: int = 5, key: str = "sourceid", time: str = "t") -> tuple[DataFrame, Column]:
    """``lc`` with the baseline of each source (_span), and its frequencies: from f_min to f_max in steps of 1 / (oversampling * baseline)."""
    spans = lc.groupBy(key).agg((F.max(time) - F.min(time)).alias("_span")).where("_span > 0")
    lc = lc.join(spans, key)
    return lc, F.transform(F.sequence(F.lit(0).cast("long"), F.round((f_max - f_min) * oversampling * F.col("_span")).cast("long")), lambda k: f_min + k / (oversampling * F.col("_span")))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 8 or more (Stirling's series)."""
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)


def log10_false_alarm(power: Column, n: Column, deviation: Column, f_max: float) -> Column:
    """Upper bound of the false-alarm probability of a standard power among n epochs whose times deviate so much; for 20 epochs or more."""
    d = (n - 3).cast("double")
    gamma = F.sqrt(2 / d) * F.exp(log_gamma(d / 2) - log_gamma((d - 1) / 2))
    rest = 1 - F.least(F.greatest(power, F.lit(0.0)), F.lit(1 - 1e-15))
    single = F.pow(rest, d / 2)
    tau = gamma * f_max * math.sqrt(4 * math.pi) * deviation * F.pow(rest, (d - 1) / 2) * F.sqrt(d / 2 * (1 - rest))
    return F.log10(single - (1 - single) * F.expm1(-tau))


def pruned_peaks(lc: DataFrame, spec: DataFrame, top: int = 30, short: float = 0.005, alias: float = 0.0, aliases: tuple[float, ...] = (), key: str = "sourceid", time: str = "t", value: str = "mag", error: str = "emag") -> DataFrame:
    """key, f, power, window_power, place (among all maxima), peak (from 1): the ``top`` strongest maxima of each spectrum that are not the sampling's.

    A maximum goes where the sampling's own power there is above it, and, unless it is below ``short``, where it is above it at f + g or
    f - g for any surviving g below ``short`` (a slow trend seen through the sampling). With ``alias`` also those within it of a period of
    ``aliases``. Whether one goes depends on the short ones that the first test leaves, which the second never takes, so the order of tests
    doesn't matter.
    """
    strongest = Window.partitionBy(key).orderBy(F.desc("power"), "f")
    own = _maxima(spec, key).where(F.col("place") <= top).where(~(F.coalesce("window_power", F.lit(0.0)) > F.col("power")))
    own = durable(own)
    slow = own.where(F.col("f") < short).select(key, F.col("f").alias("_g"))
    # few sources have slow ones, and only their detections meet the shifted frequencies
    shifted = own.where(F.col("f") >= short).join(slow, key).select(key, F.col("f").alias("_f"), "power", F.explode(F.array(F.col("f") + F.col("_g"), F.col("f") - F.col("_g"))).alias("f"))
    asked = shifted.groupBy(key).agg(F.array_sort(F.collect_set("f")).alias("_fs"))
    seen = spectrum(lc.join(asked, key), F.col("_fs"), key, time, value, error, extra=("_fs",)).select(key, "f", "window_power")
    gone = shifted.join(seen, [key, "f"]).where(F.col("window_power") > F.col("power")).select(key, F.col("_f").alias("f")).distinct()
    left = own.join(gone, [key, "f"], "left_anti")
    if alias > 0:
        left = left.where(~F.exists(F.array(*[F.lit(float(a)) for a in aliases]), lambda a: F.abs(1 / F.col("f") - a) < alias))
    return left.withColumn("peak", F.row_number().over(strongest))


def candidate_frequency(lc: DataFrame, f_min: float, f_max: float, least_points: int = 21, top: int = 0, key: str = "sourceid", time: str = "t", value: str = "mag", error: str = "emag") -> DataFrame:
    """Per source: the strongest local maximum that the sampling's own power does not reach, its power, its place among all maxima and the false-alarm bound."""
    rows = lc.where(F.col(value).isNotNull() & F.col(error).isNotNull())
    about = rows.groupBy(key).agg(F.count("*").alias("n"), F.stddev_pop(time).alias("_dev")).where(F.col("n") >= least_points)
    spec = fast_spectrum(rows.join(about.select(key), key, "left_semi"), f_min, f_max, key=key, time=time, value=value, error=error, maxima=True)
    # with ``top`` the survey's candidates, pruned by the slow ones as well; else the first maximum of any place
    if top:
        tops = pruned_peaks(rows, spec, top, key=key, time=time, value=value, error=error)
    else:
        tops = _maxima(spec, key).where("window_power <= power")
    best = tops.groupBy(key).agg(F.min_by(F.struct("f", "power", "place"), "place").alias("s")).select(key, "s.*")
    return best.join(about, key).select(key, "n", "f", "power", "place", log10_false_alarm(F.col("power"), F.col("n"), F.col("_dev"), f_max).alias("log10_fap"))


def without_cubic(lc: DataFrame, key: str = "sourceid", time: str = "t", value: str = "mag", error: str = "emag") -> DataFrame:
    """``lc`` with ``residual``: values minus their weighted cubic in time, by polynomials that are orthogonal over each source's own epochs.

    One shuffle by source, a sum over the source for each coefficient; a source of k points gets a polynomial of degree k - 1 at most.
    """
    all_ = Window.partitionBy(key)
    w, t = 1 / (F.col(error) * F.col(error)), F.col("_t")
    total = lambda c: F.sum(w * c).over(all_)
    known = F.col(value).isNotNull() & F.col(error).isNotNull()
    rows = lc.where(known).withColumn("_n", F.count("*").over(all_)).withColumn("_t", F.col(time) - F.avg(time).over(all_)).withColumns({"_p0": F.lit(1.0), "residual": F.col(value)})
    for k in range(4):
        p = F.col(f"_p{k}")
        rows = rows.withColumn(f"_s{k}", total(p * p))
        rows = rows.withColumn("residual", F.col("residual") - F.when(F.col("_n") > k, F.coalesce(F.try_divide(total(F.col("residual") * p), F.col(f"_s{k}")), F.lit(0.0))).otherwise(0.0) * p)
        if k < 3:
            before = F.coalesce(F.try_divide(F.col(f"_s{k}"), F.col(f"_s{k - 1}")), F.lit(0.0)) * F.col(f"_p{k - 1}") if k else F.lit(0.0)
            rows = rows.withColumn(f"_p{k + 1}", (t - F.coalesce(F.try_divide(total(t * p * p), F.col(f"_s{k}")), F.lit(0.0))) * p - before)
    return rows.drop("_n", "_t", *[f"_{c}{k}" for k in range(4) for c in "ps"])


def peaks(spec: DataFrame, top: int, key: str = "sourceid") -> DataFrame:
    """The ``top`` strongest local maxima (above both neighbours) of each spectrum: key, f, power, peak (from 1)."""
    return _maxima(spec, key).where(F.col("place") <= top).select(key, "f", "power", F.col("place").alias("peak"))


def turning_points(curve: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Points of a sampled curve after which its slope changes sign."""
    order = Window.partitionBy(key).orderBy(x)
    slope = curve.withColumn("_d", F.lead(y).over(order) - F.col(y))
    return slope.withColumn("_e", F.lead("_d").over(order)).where("_d * _e < 0").withColumn("kind", F.when(F.col("_d") > 0, "max").otherwise("min")).drop("_d", "_e")


def detrended(lc: DataFrame, key: str = "sourceid", time: str = "t", value: str = "mag", error: str = "emag") -> DataFrame:
    """Values minus their weighted straight line: closed form of five sums per source."""
    w = 1 / (F.col(error) * F.col(error))
    t, y = F.col(time), F.col(value)
    fit = lc.groupBy(key).agg(F.sum(w).alias("s"), F.sum(w * t).alias("st"), F.sum(w * y).alias("sy"), F.sum(w * t * t).alias("stt"), F.sum(w * t * y).alias("sty"))
    slope = F.try_divide(F.col("s") * F.col("sty") - F.col("st") * F.col("sy"), F.col("s") * F.col("stt") - F.col("st") * F.col("st"))
    fit = fit.withColumn("slope", slope).withColumn("level", (F.col("sy") - F.col("slope") * F.col("st")) / F.col("s"))
    return lc.join(fit.select(key, "slope", "level"), key).withColumn("residual", y - F.col("level") - F.col("slope") * t)


def phase_depth(lc: DataFrame, period: str | Column, low: float = 0.1, high: float = 0.9, key: str = "sourceid", time: str = "t", value: str = "mag") -> DataFrame:
    """Share of the range that the phases around the faintest point fall below: (p_high - median) / (p_high - p_low) of the values within a quarter turn."""
    folded = lc.withColumn("_p", phase(time, period))
    faint = folded.groupBy(key).agg(F.max_by("_p", F.struct(value, "_p")).alias("_zero"))
    turn = F.abs(F.col("_p") - F.col("_zero"))
    near = folded.join(faint, key).where(F.least(turn, 1 - turn) < 0.25)
    g = near.groupBy(key).agg(F.percentile(value, F.array(F.lit(low), F.lit(0.5), F.lit(high))).alias("_q"))
    return g.select(key, ratio(F.col("_q")[2] - F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0]).alias("percentile_diff"))
