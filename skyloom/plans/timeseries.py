"""Folding, gaps, nearest epochs, colours, spectra and peaks of light curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.operators import curves, fourier, joins, series, stats
from skyloom.plans.registry import Registry, count, r
from skyloom.sources.views import DETECTIONS, detections

query = Registry()
PERIOD = 1.37


@query(f"WITH {DETECTIONS} SELECT sourceid, count(*) AS n, round(sum(mag), 4) + 0.0 AS total, min(t) AS first FROM lc GROUP BY 1")
def explode_arrays(spark, d):
    """Rows to one row of parallel arrays per source and back."""
    from pyspark.sql.functions import array_sort, collect_list, struct

    arrays = detections(spark, d).groupBy("sourceid").agg(array_sort(collect_list(struct("t", "event_id", "mag"))).alias("a")).select("sourceid", F.col("a.t").alias("t"), F.col("a.mag").alias("mag"))
    rows = arrays.select("sourceid", F.inline(F.arrays_zip("t", "mag")))
    return rows.groupBy("sourceid").agg(count().alias("n"), r(F.sum("mag"), 4).alias("total"), F.min("t").alias("first"))


@query(f"WITH {DETECTIONS} SELECT event_id, sourceid, round(fmod(t - 0.25 + 10 * {PERIOD}, {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE, 6) + 0.0 AS phase FROM lc")
def phase_fold(spark, d):
    return detections(spark, d).select("event_id", "sourceid", r(expr.phase("t", F.lit(PERIOD), F.lit(0.25))).alias("phase"))


FOLD = f"f AS (SELECT *, fmod(t, {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE AS p FROM lc)"


@query(f"""WITH {DETECTIONS}, {FOLD}, g AS (SELECT sourceid, coalesce(lead(p) OVER (PARTITION BY sourceid ORDER BY p) - p, min(p) OVER (PARTITION BY sourceid) + 1 - p) AS gap FROM f)
SELECT sourceid, round(max(gap), 6) + 0.0 AS max_phase_lag, round(abs(max(gap) - avg(gap)) / nullif(stddev_pop(gap), 0), 5) + 0.0 AS phase_lag_mean FROM g GROUP BY 1""")
def phase_lag(spark, d):
    g = series.phase_gaps(detections(spark, d), F.lit(PERIOD))
    return g.select("sourceid", r("max_phase_lag").alias("max_phase_lag"), r("phase_lag_mean", 5).alias("phase_lag_mean"))


@query(f"""WITH {DETECTIONS}, {FOLD}, v AS (SELECT sourceid, p, (mag - min(mag) OVER w) / nullif(max(mag) OVER w - min(mag) OVER w, 0) AS v FROM f WINDOW w AS (PARTITION BY sourceid)),
l AS (SELECT sourceid, coalesce(lead(p) OVER o, first_value(p) OVER o + 1) - p AS dp, coalesce(lead(v) OVER o, first_value(v) OVER o) - v AS dv FROM v WINDOW o AS (PARTITION BY sourceid ORDER BY p, v))
SELECT sourceid, round(sum(sqrt(dp * dp + dv * dv)), 5) + 0.0 AS string_length FROM l GROUP BY 1""")
def string_length(spark, d):
    return series.string_length(detections(spark, d), F.lit(PERIOD)).select("sourceid", r("string_length", 5).alias("string_length"))


@query(f"""WITH {DETECTIONS}, {FOLD}, n AS (SELECT a.sourceid, a.event_id, a.p, a.mag, b.mag AS m2, b.emag AS e2, row_number() OVER (PARTITION BY a.event_id ORDER BY least(abs(a.p - b.p), 1 - abs(a.p - b.p)), b.event_id) AS k
FROM f a JOIN f b ON a.sourceid = b.sourceid AND a.event_id <> b.event_id)
SELECT sourceid, round(avg(abs(mag - l)), 5) + 0.0 AS scatter, count(*) AS n FROM (SELECT sourceid, event_id, any_value(mag) AS mag, sum(m2 / (e2 * e2)) / sum(1 / (e2 * e2)) AS l FROM n WHERE k <= 5 GROUP BY ALL) GROUP BY 1""")
def symmetry(spark, d):
    """Mean distance of each detection from the weighted mean of its five neighbours in phase."""
    near = series.nearest_in_phase(detections(spark, d), F.lit(PERIOD), 5)
    return near.groupBy("sourceid").agg(r(F.avg(F.abs(F.col("mag") - F.col("local_mean"))), 5).alias("scatter"), count().alias("n"))


@query(f"""WITH {DETECTIONS}, o AS (SELECT sourceid, t AS t0 FROM lc QUALIFY row_number() OVER (PARTITION BY sourceid ORDER BY mag DESC, event_id) = 5)
SELECT sourceid, count(*) AS n, round(avg(fmod(t - t0 + 50 * {PERIOD}, {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE), 6) + 0.0 AS mean_phase FROM lc JOIN o USING (sourceid) WHERE t <> t0 GROUP BY 1""")
def ranked_origin(spark, d):
    """Folds at the fifth highest value of each source."""
    lc = detections(spark, d)
    origin = lc.withColumn("k", F.row_number().over(Window.partitionBy("sourceid").orderBy(F.desc("mag"), "event_id"))).where("k = 5").select("sourceid", F.col("t").alias("t0"))
    return lc.join(origin, "sourceid").where("t <> t0").groupBy("sourceid").agg(count().alias("n"), r(F.avg(expr.phase("t", F.lit(PERIOD), F.col("t0")))).alias("mean_phase"))


@query(f"""WITH {DETECTIONS}, m AS (SELECT a.event_id, a.sourceid, a.t, a.mag, a.emag, b.t AS t2, b.mag AS m2, b.emag AS e2 FROM lc a JOIN lc b ON a.sourceid = b.sourceid AND a.filterid = 3 AND b.filterid = 5 AND abs(a.t - b.t) < 0.5
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) = 1)
SELECT event_id, sourceid, round(t2, 6) + 0.0 AS nearest_t, round(mag - m2, 5) + 0.0 AS colour FROM m""")
def nearest_epoch(spark, d):
    """Detections of one band with the nearest of the reference band within half a day."""
    lc = detections(spark, d)
    a, b = lc.where("filterid = 3").select("event_id", "sourceid", "t", "mag"), lc.where("filterid = 5").select("sourceid", "t", "mag")
    m = joins.nearest_in_time(a, b, "sourceid", "t", 0.5, ["mag"])
    return m.select("event_id", "sourceid", r("nearest_t").alias("nearest_t"), r(F.col("mag") - F.col("nearest_mag"), 5).alias("colour"))


@query(f"""WITH {DETECTIONS}, m AS (SELECT a.event_id, a.sourceid, a.mag, a.emag, b.mag AS m2, b.emag AS e2 FROM lc a JOIN lc b ON a.sourceid = b.sourceid AND a.filterid = 4 AND b.filterid = 5 AND abs(a.t - b.t) < 1
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) = 1),
c AS (SELECT *, mag - sum(mag / (emag * emag)) OVER w / sum(1 / (emag * emag)) OVER w AS da, m2 - sum(m2 / (e2 * e2)) OVER w / sum(1 / (e2 * e2)) OVER w AS db FROM m WINDOW w AS (PARTITION BY sourceid))
SELECT sourceid, count(*) AS n, round(sqrt((sum(da * da / (emag * emag)) / sum(1 / (emag * emag))) / nullif(sum(db * db / (e2 * e2)) / sum(1 / (e2 * e2)), 0)), 5) + 0.0 AS scatter_ratio FROM c GROUP BY 1""")
def contemp_scatter(spark, d):
    """Ratio of weighted scatters of two bands at epochs that both have."""
    lc = detections(spark, d)
    a, b = lc.where("filterid = 4").select("event_id", "sourceid", "t", "mag", "emag"), lc.where("filterid = 5").select("sourceid", "t", "mag", "emag")
    m = joins.nearest_in_time(a, b, "sourceid", "t", 1.0, ["mag", "emag"])
    w = Window.partitionBy("sourceid")
    off = lambda v, e: F.col(v) - F.sum(F.col(v) / (F.col(e) * F.col(e))).over(w) / F.sum(1 / (F.col(e) * F.col(e))).over(w)
    c = m.withColumns({"da": off("mag", "emag"), "db": off("nearest_mag", "nearest_emag")})
    s = lambda v, e: stats.weighted_mean(F.col(v) * F.col(v), e)
    return c.groupBy("sourceid").agg(count().alias("n"), r(F.sqrt(F.try_divide(s("da", "emag"), s("db", "nearest_emag"))), 5).alias("scatter_ratio"))


@query(f"WITH {DETECTIONS} SELECT sourceid, " + ", ".join(f"count(*) FILTER (filterid = {k}) AS n{k}, round(sum(mag / (emag * emag)) FILTER (filterid = {k}) / sum(1 / (emag * emag)) FILTER (filterid = {k}), 5) + 0.0 AS m{k}" for k in range(1, 6)) + " FROM lc GROUP BY 1")
def band_pivot(spark, d):
    """Count and weighted mean of each band in columns of their own."""
    g = detections(spark, d).groupBy("sourceid").pivot("filterid", list(range(1, 6))).agg(count("event_id").alias("n"), stats.weighted_mean("mag", "emag").alias("m"))
    return g.select("sourceid", *[c for k in range(1, 6) for c in (F.coalesce(f"{k}_n", F.lit(0)).cast("long").alias(f"n{k}"), r(f"{k}_m", 5).alias(f"m{k}"))])


@query(f"""WITH {DETECTIONS}, d AS (SELECT *, mag - avg(mag) OVER (PARTITION BY sourceid) AS y, sin(2 * pi() * t / {PERIOD}) AS x FROM lc WHERE filterid = 5),
s AS (SELECT sourceid, count(*) AS n, sum(1 / (emag * emag)) AS s, sum(x / (emag * emag)) AS sx, sum(y / (emag * emag)) AS sy, sum(x * x / (emag * emag)) AS sxx, sum(x * y / (emag * emag)) AS sxy FROM d GROUP BY 1)
SELECT sourceid, n, CASE WHEN n >= 3 AND greatest((s * sxy - sx * sy) / nullif(s * sxx - sx * sx, 0), 0) >= 1e-4 THEN round((s * sxy - sx * sy) / (s * sxx - sx * sx), 4) + 0.0 END AS scale FROM s""")
def model_scale(spark, d):
    """Weighted scale of a unit model against one band, not negative; too few points or no scale give null."""
    w = Window.partitionBy("sourceid")
    m = detections(spark, d).where("filterid = 5").withColumns({"y": F.col("mag") - F.avg("mag").over(w), "x": F.sin(expr.TWO_PI * F.col("t") / PERIOD), "w": 1 / (F.col("emag") * F.col("emag"))})
    g = m.groupBy("sourceid").agg(count().alias("n"), *[F.sum(F.col("w") * v).alias(a) for a, v in (("s", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")))])
    scale = F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return g.select("sourceid", "n", F.when((F.col("n") >= 3) & (scale >= 1e-4), r(scale, 4)).alias("scale"))


@query(f"""WITH {DETECTIONS}, s AS (SELECT sourceid, sum(1 / (emag * emag)) AS s, sum(t / (emag * emag)) AS st, sum(mag / (emag * emag)) AS sy, sum(t * t / (emag * emag)) AS stt, sum(t * mag / (emag * emag)) AS sty FROM lc GROUP BY 1),
k AS (SELECT sourceid, (s * sty - st * sy) / (s * stt - st * st) AS slope, sy / s - (s * sty - st * sy) / (s * stt - st * st) * st / s AS level FROM s)
SELECT sourceid, round(any_value(slope), 5) + 0.0 AS slope, round(stddev_pop(mag - level - slope * t), 5) + 0.0 AS scatter FROM lc JOIN k USING (sourceid) GROUP BY 1""")
def line_detrend(spark, d):
    m = series.detrended(detections(spark, d))
    return m.groupBy("sourceid").agg(r(F.first("slope"), 5).alias("slope"), r(F.stddev_pop("residual"), 5).alias("scatter"))


#: Frequencies of the spectrum queries, a day: each source's grid follows its baseline, in steps of 1 / (5 * span).
LOW, HIGH, TOP = 0.05, 5.0, 20.0


def _ls(window: bool, high: float) -> str:
    y = "1.0::DOUBLE" if window else "mag - sum(mag / (emag * emag)) OVER p / sum(1 / (emag * emag)) OVER p"
    k = 0 if window else 1
    return f"""{DETECTIONS}, v AS (SELECT sourceid, t, (1 / (emag * emag)) / sum(1 / (emag * emag)) OVER p AS w, {y} AS y FROM lc WINDOW p AS (PARTITION BY sourceid)),
a AS (SELECT sourceid, max(t) - min(t) AS span FROM lc GROUP BY 1),
fr AS (SELECT sourceid, {LOW}::DOUBLE + unnest(range(0, 1 + round(({high}::DOUBLE - {LOW}::DOUBLE) * 5 * span)::BIGINT)) / (5 * span) AS f FROM a WHERE span > 0),
q AS (SELECT sourceid, f, sum(w * cos(2 * pi() * f * t)) AS c, sum(w * sin(2 * pi() * f * t)) AS s, sum(w * y * y) AS yy, sum(w * y * cos(2 * pi() * f * t)) AS yc, sum(w * y * sin(2 * pi() * f * t)) AS ys,
  sum(w * cos(2 * pi() * f * t) * cos(2 * pi() * f * t)) AS cc, sum(w * cos(2 * pi() * f * t) * sin(2 * pi() * f * t)) AS cs FROM v JOIN fr USING (sourceid) GROUP BY ALL),
z AS (SELECT sourceid, f, yy, yc, ys, cc - {k} * c * c AS cc, 1 - cc - {k} * s * s AS ss, cs - {k} * c * s AS cs FROM q),
spec AS (SELECT sourceid, f, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / nullif(yy * (cc * ss - cs * cs), 0) AS power FROM z)"""


def own_spectrum(spark, d, high: float = TOP, maxima: bool = False):
    return series.fast_spectrum(detections(spark, d), LOW, high, maxima=maxima)


@query(f"WITH {_ls(False, HIGH)} SELECT sourceid, round(f, 6) + 0.0 AS f, round(power, 6) + 0.0 AS power FROM spec")
def ls_power(spark, d):
    return own_spectrum(spark, d, HIGH).select("sourceid", r("f").alias("f"), r("power").alias("power"))


@query(f"WITH {_ls(True, TOP)} SELECT sourceid, round(max(power), 5) + 0.0 AS max_power, round(avg(power), 5) + 0.0 AS mean_power FROM spec GROUP BY 1")
def window_power(spark, d):
    s = own_spectrum(spark, d)
    return s.groupBy("sourceid").agg(r(F.max("window_power"), 5).alias("max_power"), r(F.avg("window_power"), 5).alias("mean_power"))


@query(f"WITH {_ls(False, TOP)} SELECT sourceid, round(abs(max(power) - avg(power)) / nullif(stddev_pop(power), 0), 4) + 0.0 AS significance, round(1 / max_by(f, power), 4) + 0.0 AS best_period FROM spec GROUP BY 1")
def power_stats(spark, d):
    s = own_spectrum(spark, d)
    return s.groupBy("sourceid").agg(r(expr.ratio(F.abs(F.max("power") - F.avg("power")), F.stddev_pop("power")), 4).alias("significance"), r(1 / F.max_by("f", "power"), 4).alias("best_period"))


@query(f"""WITH {_ls(False, TOP)}, l AS (SELECT *, lag(power) OVER o AS a, lead(power) OVER o AS b FROM spec WINDOW o AS (PARTITION BY sourceid ORDER BY f))
SELECT sourceid, round(f, 4) + 0.0 AS f, peak FROM (SELECT sourceid, f, row_number() OVER (PARTITION BY sourceid ORDER BY power DESC, f) AS peak FROM l WHERE power > a AND power > b) WHERE peak <= 5""")
def ls_peaks_topn(spark, d):
    p = series.peaks(own_spectrum(spark, d, maxima=True), 5)
    return p.select("sourceid", r("f", 4).alias("f"), F.col("peak").cast("long").alias("peak"))


CURVE = "c AS (SELECT vec_id, k, " + " + ".join(f"abs(CAST(embedding[{n + 4}] AS DOUBLE)) * cos(2 * pi() * {n} * k / 1000 + 2 * pi() * CAST(embedding[{n + 8}] AS DOUBLE))" for n in range(1, 5)) + " AS m FROM embeddings, range(1000) t(k))"


def model_curve(spark, d, points: int = 1000):
    """Four-harmonic model of each vector on a phase grid."""
    from skyloom.sources.views import table

    e = table(spark, d, "embeddings")
    pairs = [(f"a{n}", f"p{n}") for n in range(1, 5)]
    named = e.select("vec_id", *[F.abs(F.col("embedding")[n + 3].cast("double")).alias(f"a{n}") for n in range(1, 5)], *[(expr.TWO_PI * F.col("embedding")[n + 7].cast("double")).alias(f"p{n}") for n in range(1, 5)])
    grid = named.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.select("vec_id", "k", expr.series_value(pairs, F.col("k") / points).alias("m"))


@query(f"WITH {CURVE} SELECT vec_id, round(max(m) - min(m), 6) + 0.0 AS amplitude, round(min(m), 6) + 0.0 AS brightest, max_by(k, m) AS phase_of_minimum FROM c GROUP BY 1")
def model_amplitude(spark, d):
    c = model_curve(spark, d)
    return c.groupBy("vec_id").agg(r(F.max("m") - F.min("m")).alias("amplitude"), r(F.min("m")).alias("brightest"), F.max_by("k", "m").cast("long").alias("phase_of_minimum"))


@query(f"WITH {CURVE}, s AS (SELECT *, lead(m) OVER w - m AS d, lead(m, 2) OVER w - lead(m) OVER w AS e FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, count(*) FILTER (d > 0) AS maxima, count(*) FILTER (d < 0) AS minima FROM s WHERE d * e < 0 GROUP BY 1")
def turning_points(spark, d):
    p = series.turning_points(model_curve(spark, d), "vec_id", "k", "m")
    return p.groupBy("vec_id").agg(F.count_if(F.col("kind") == "max").alias("maxima"), F.count_if(F.col("kind") == "min").alias("minima"))


def _vector_curve(order: int) -> str:
    """A four-harmonic curve of each vector, or a derivative, in SQL."""
    rate = lambda k: f"power(2 * pi() * {k}, {order}) * "
    s, c = (("sin({})", "cos({})"), ("cos({})", "(-sin({}))"), ("(-sin({}))", "(-cos({}))"))[order]
    own = [f"CAST(embedding[{k + 1}] AS DOUBLE) * {rate(k)}{s.format(f'2 * pi() * {k} * p')} + CAST(embedding[{k + 5}] AS DOUBLE) * {rate(k)}{c.format(f'2 * pi() * {k} * p')}" for k in range(1, 5)]
    return " + ".join([*own, *(["CAST(embedding[1] AS DOUBLE)"] if order == 0 else [])])


#: Variance of a curve whose coefficients have the covariance v v' + 0.01 on the diagonal; v is the components that follow.
_SPREAD = "power(CAST(embedding[10] AS DOUBLE) + " + " + ".join(f"CAST(embedding[{k + 10}] AS DOUBLE) * sin(2 * pi() * {k} * p) + CAST(embedding[{k + 14}] AS DOUBLE) * cos(2 * pi() * {k} * p)" for k in range(1, 5)) + ", 2) + 0.05"


def vector_curves(spark, d):
    """Vectors as fitted curves: level, four sines, four cosines and their covariance."""
    from skyloom.sources.views import table

    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = F.slice("e", 10, 9)
    return e.select("vec_id", F.slice("e", 1, 9).alias("coef"), F.transform(v, lambda x, i: F.transform(v, lambda y, j: x * y + F.when(i == j, 0.01).otherwise(0.0))).alias("cov"))


@query(f"""WITH g AS (SELECT vec_id, k, {_vector_curve(0)} AS value, sqrt({_SPREAD}) AS error, {_vector_curve(1)} AS slope, {_vector_curve(2)} AS bend FROM (SELECT vec_id, embedding, k, k / 100::DOUBLE AS p FROM embeddings, range(100) t(k)))
SELECT vec_id, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS peak, round(min(error), 6) + 0.0 AS least_error, round(max(error), 6) + 0.0 AS most_error, round(max(slope), 4) + 0.0 AS steepest, round(min(bend), 3) + 0.0 AS sharpest FROM g GROUP BY 1""")
def curve_shapes(spark, d):
    """Fitted curves on a phase grid: values, propagated errors, first and second derivatives."""
    g = curves.on_grid(vector_curves(spark, d), 100)
    return g.groupBy("vec_id").agg(r(F.avg("value")).alias("mean"), r(F.max("value")).alias("peak"), r(F.min("error")).alias("least_error"), r(F.max("error")).alias("most_error"), r(F.max("slope"), 4).alias("steepest"), r(F.min("bend"), 3).alias("sharpest"))


@query()
def curve_covariances(spark, d):
    """Covariances of amplitudes, phases and phase differences of each vector's curve over 300 draws."""
    return curves.covariances(vector_curves(spark, d), "vec_id")


@query(f"""WITH {DETECTIONS}, c AS (SELECT sourceid, 0.003 + (sourceid % 10) / 10::DOUBLE AS zero, CASE WHEN sourceid % 2 = 0 THEN 0.43 END AS second FROM lc GROUP BY 1),
a AS (SELECT *, CASE WHEN second IS NULL THEN 2 * {PERIOD}::DOUBLE ELSE {PERIOD}::DOUBLE END AS period, coalesce(second, 0.5) AS apart FROM c),
b AS (SELECT sourceid, quantile_cont(mag, 0.01) AS low FROM lc GROUP BY 1),
w AS (SELECT a.*, k, 0.05 + 0.01 * k::DOUBLE AS width FROM a, range(47) t(k) WHERE k <= floor((apart - 0.05) / 0.01) + 1),
p AS (SELECT w.sourceid, k, width, apart, mag, emag, fmod((t - zero * {PERIOD}::DOUBLE) / period + width + 1000, 1) AS p FROM w JOIN lc ON w.sourceid = lc.sourceid),
n AS (SELECT sourceid, k, any_value(width) AS width, count(*) FILTER (p < width) AS n1, count(*) FILTER (p > apart AND p < apart + width) AS n2,
  sum(mag / (emag * emag)) FILTER (p < width) / sum(1 / (emag * emag)) FILTER (p < width) AS m1, sum(mag / (emag * emag)) FILTER (p > apart AND p < apart + width) / sum(1 / (emag * emag)) FILTER (p > apart AND p < apart + width) AS m2 FROM p GROUP BY 1, 2),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY sourceid ORDER BY n1 < 3 OR n2 < 3, CASE WHEN n1 < 3 OR n2 < 3 THEN -k ELSE k END) = 1)
SELECT sourceid, round(width, 2) + 0.0 AS half_width, n1, n2, CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN round(least(m1 - low, m2 - low) / nullif(greatest(m1 - low, m2 - low), 0), 5) + 0.0 END AS peak_ratio FROM f JOIN b USING (sourceid)""")
def peak_depths(spark, d):
    """Ratio of both dips' depths in the detections, in the narrowest windows that hold three detections each."""
    lc = detections(spark, d)
    zero = 0.003 + (F.col("sourceid") % 10) / 10
    about = lc.select("sourceid").distinct().select("sourceid", F.lit(PERIOD).alias("period"), zero.alias("min_phase"), F.when(F.col("sourceid") % 2 == 0, F.lit(0.43)).alias("second_phase"))
    out = curves.depth_ratio(lc, about)
    return out.select("sourceid", r("half_width", 2).alias("half_width"), "n1", "n2", r("peak_ratio_data", 5).alias("peak_ratio"))


_MODEL = " + ".join(f"{a} * cos(2 * pi() * {k} * fmod(t, {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE + {k} * (sourceid % 5))" for k, a in ((1, 8.0), (2, 4.0), (3, 2.0), (4, 1.0)))


@query(f"""WITH {DETECTIONS}, m AS (SELECT *, 1 / (emag * emag) AS w, {_MODEL} AS x FROM lc),
a AS (SELECT *, sum(w * mag) OVER p / sum(w) OVER p AS my, sum(w * x) OVER p / sum(w) OVER p AS mx FROM m WINDOW p AS (PARTITION BY sourceid, filterid)),
g AS (SELECT sourceid, filterid, count(*) AS nobs, power(median(emag), 2) AS noise, sum(w * power(mag - my, 2)) / sum(w) AS own, sum(w * power(x - mx, 2)) / sum(w) AS other, sum(w * (x - mx) * (mag - my)) / sum(w) AS shared FROM a GROUP BY 1, 2)
SELECT sourceid, filterid, nobs, CASE WHEN nobs > 1 THEN round(sqrt(CASE WHEN own > noise THEN own - noise ELSE own END / other), 5) + 0.0 END AS model, CASE WHEN nobs > 2 AND shared / other >= 1e-4 THEN round(shared / other, 5) + 0.0 END AS scale FROM g""")
def band_scales(spark, d):
    """Each band's scatter and best factor against the source's curve of four harmonics."""
    lc = detections(spark, d)
    turn = F.col("sourceid") % 5
    curve = lc.select("sourceid").distinct().select("sourceid", F.lit(PERIOD).alias("period"), F.array(*[F.lit(a) for a in (8.0, 4.0, 2.0, 1.0)]).alias("amplitudes"), F.array(*[(k * turn).cast("double") for k in (1, 2, 3, 4)]).alias("phases"))
    out = curves.against_bands(lc, curve)
    return out.select("sourceid", "filterid", "nobs", r("model", 5).alias("model"), r("scale", 5).alias("scale"))


@query(f"""WITH {DETECTIONS}, f AS (SELECT sourceid, k, mag, 0.1 + 0.05 * k::DOUBLE AS f, fmod(t, 1 / (0.1 + 0.05 * k::DOUBLE)) / (1 / (0.1 + 0.05 * k::DOUBLE)) AS p FROM lc, range(100) t(k)),
v AS (SELECT sourceid, f, p, (mag - min(mag) OVER w) / nullif(max(mag) OVER w - min(mag) OVER w, 0) AS v FROM f WINDOW w AS (PARTITION BY sourceid)),
l AS (SELECT sourceid, f, coalesce(lead(p) OVER o, first_value(p) OVER o + 1) - p AS dp, coalesce(lead(v) OVER o, first_value(v) OVER o) - v AS dv FROM v WINDOW o AS (PARTITION BY sourceid, f ORDER BY p, v)),
s AS (SELECT sourceid, f, sum(sqrt(dp * dp + dv * dv)) AS s FROM l GROUP BY 1, 2)
SELECT sourceid, round(f, 4) + 0.0 AS f, round(s, 5) + 0.0 AS string_length FROM s QUALIFY row_number() OVER (PARTITION BY sourceid ORDER BY s, f) = 1""")
def string_length_search(spark, d):
    """The period of a grid whose folded line is shortest."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: 0.1 + 0.05 * k)
    return series.string_length_search(detections(spark, d), grid).select("sourceid", r("f", 4).alias("f"), r("string_length", 5).alias("string_length"))


@query()
def smoothing_search(spark, d):
    """The ridge that cross-validation prefers for six harmonics of a source's proposed frequency."""
    lc = detections(spark, d)
    found = series.candidate_frequency(lc, F_MIN, F_MAX).select("sourceid", "f", F.lit(6).alias("high"))
    w = 1 / (F.col("emag") * F.col("emag"))
    about = lc.groupBy("sourceid").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), stats.weighted_mean("mag", "emag").alias("mean"))
    rows = lc.join(about, "sourceid").where("t1 > t0").select("sourceid", "t", ((2 * F.col("t") - F.col("t0") - F.col("t1")) / (F.col("t1") - F.col("t0"))).alias("u"), (F.col("mag") - F.col("mean")).alias("y"), w.alias("w"))
    return fourier.ridges(rows, found, 3).select("sourceid", "f", "ridge", "gcv", "dof")


@query("WITH p AS (SELECT vec_id, " + ", ".join(f"2 * pi() * CAST(embedding[{k + 1}] AS DOUBLE) AS phi{k}, abs(CAST(embedding[{k + 5}] AS DOUBLE)) AS a{k}" for k in range(4)) + " FROM embeddings) SELECT vec_id, "
       + ", ".join(f"round(fmod(fmod({j + 1} * phi{i} - {i + 1} * phi{j}, 2 * pi()) + 2 * pi(), 2 * pi()), 5) + 0.0 AS phi{i}_phi{j}" for j in range(4) for i in range(j + 1, 4)) + ", "
       + ", ".join(f"round(a{i} / nullif(a{j}, 0), 4) + 0.0 AS a{i}_a{j}" for j in range(4) for i in range(j + 1, 4)) + ", round(cos(phi0), 6) + 0.0 AS cos_phi0, round(sin(phi0), 6) + 0.0 AS sin_phi0 FROM p")
def phase_diffs(spark, d):
    """Phase differences, amplitude ratios and circle features of four harmonics."""
    from skyloom.sources.views import table

    e = table(spark, d, "embeddings").select("vec_id", *[(expr.TWO_PI * F.col("embedding")[k].cast("double")).alias(f"phi{k}") for k in range(4)], *[F.abs(F.col("embedding")[k + 4].cast("double")).alias(f"a{k}") for k in range(4)])
    wide = e.select("vec_id", *expr.phase_differences([f"phi{k}" for k in range(4)]), *expr.amplitude_ratios([f"a{k}" for k in range(4)]), *expr.circle_features(["phi0"]))
    return wide.select("vec_id", *[r(c, 5 if c.startswith("phi") else 4 if c.startswith("a") else 6).alias(c) for c in wide.columns[1:]])


@query(f"""WITH {DETECTIONS}, g AS (SELECT sourceid, sum(mag / (emag * emag)) / sum(1 / (emag * emag)) AS c, avg(mag) AS a FROM lc GROUP BY 1)
SELECT sourceid, round(sum(-0.5 * (power((mag - a) / emag, 2) - power((mag - c) / emag, 2))) / count(*), 6) + 0.0 AS delta_loglik FROM lc JOIN g USING (sourceid) GROUP BY 1""")
def delta_loglik(spark, d):
    """Gaussian log-likelihood of the plain mean against the weighted mean, per detection."""
    lc = detections(spark, d)
    g = lc.groupBy("sourceid").agg(stats.weighted_mean("mag", "emag").alias("c"), F.avg("mag").alias("a"))
    term = lambda m: F.pow((F.col("mag") - F.col(m)) / F.col("emag"), 2)
    return lc.join(g, "sourceid").groupBy("sourceid").agg(r(F.sum(-0.5 * (term("a") - term("c"))) / F.count("*")).alias("delta_loglik"))


@query(f"""WITH {DETECTIONS}, g AS (SELECT sourceid, quantile_cont(mag, 0.95) - quantile_cont(mag, 0.05) AS r, median(emag) AS e, count(*) AS n FROM lc GROUP BY 1)
SELECT sourceid, round(least(0.25::DOUBLE, 2 / power(r / e, 3) / (n / 100.0::DOUBLE)), 8) + 0.0 AS regularisation FROM g""")
def optimal_regularisation(spark, d):
    g = detections(spark, d).groupBy("sourceid").agg(F.percentile("mag", F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.median("emag").alias("e"), F.count("*").alias("n"))
    return g.select("sourceid", r(F.least(F.lit(0.25), 2 / F.pow((F.col("p")[1] - F.col("p")[0]) / F.col("e"), 3) / (F.col("n") / 100)), 8).alias("regularisation"))


@query(f"""WITH {DETECTIONS}, {FOLD}, z AS (SELECT sourceid, max_by(p, (mag, p)) AS z FROM f GROUP BY 1),
n AS (SELECT sourceid, mag FROM f JOIN z USING (sourceid) WHERE least(abs(p - z), 1 - abs(p - z)) < 0.25)
SELECT sourceid, round((quantile_cont(mag, 0.9) - median(mag)) / nullif(quantile_cont(mag, 0.9) - quantile_cont(mag, 0.1), 0), 5) + 0.0 AS percentile_diff FROM n GROUP BY 1""")
def percentile_diff(spark, d):
    return series.phase_depth(detections(spark, d), F.lit(PERIOD)).select("sourceid", r("percentile_diff", 5).alias("percentile_diff"))


def _cubic() -> str:
    """Polynomials that are orthogonal over each source's epochs, one after another."""
    over = lambda x: f"sum(w * {x}) OVER p"
    part = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
    steps = ["r0 AS (SELECT sourceid, event_id, mag AS y, t - avg(t) OVER p AS t, count(*) OVER p AS n, 1 / (emag * emag) AS w, 1.0::DOUBLE AS p0 FROM lc WINDOW p AS (PARTITION BY sourceid))"]
    for k in range(4):
        steps.append(f"s{k} AS (SELECT *, {over(f'p{k} * p{k}')} AS q{k} FROM r{k} WINDOW p AS (PARTITION BY sourceid))")
        back = f" - {part(f'q{k}', f'q{k - 1}')} * p{k - 1}" if k else ""
        after = f", (t - {part(over(f't * p{k} * p{k}'), f'q{k}')}) * p{k}{back} AS p{k + 1}" if k < 3 else ""
        steps.append(f"r{k + 1} AS (SELECT * EXCLUDE (y), y - CASE WHEN n > {k} THEN {part(over(f'y * p{k}'), f'q{k}')} ELSE 0 END * p{k} AS y{after} FROM s{k} WINDOW p AS (PARTITION BY sourceid))")
    return ", ".join(steps)


@query(f"WITH {DETECTIONS}, {_cubic()} SELECT sourceid, count(*) AS n, round(stddev_pop(y), 5) + 0.0 AS scatter FROM r4 GROUP BY 1")
def poly_detrend(spark, d):
    """Scatter around a cubic of each source."""
    return series.without_cubic(detections(spark, d)).groupBy("sourceid").agg(count("event_id").alias("n"), r(F.stddev_pop("residual"), 5).alias("scatter"))


_GAMMA = "(({x} - 0.5) * ln({x}) - {x} + 0.5 * ln(2 * pi()) + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}))"
F_MIN, F_MAX = 0.00066667, 20.0


@query(f"""WITH {DETECTIONS}, a AS (SELECT sourceid, count(*) AS n, stddev_pop(t) AS dev, max(t) - min(t) AS span FROM lc GROUP BY 1 HAVING count(*) >= 21),
v AS (SELECT sourceid, t, (1 / (emag * emag)) / sum(1 / (emag * emag)) OVER p AS w, mag - sum(mag / (emag * emag)) OVER p / sum(1 / (emag * emag)) OVER p AS y FROM lc WHERE sourceid IN (SELECT sourceid FROM a) WINDOW p AS (PARTITION BY sourceid)),
fr AS (SELECT sourceid, {F_MIN}::DOUBLE + unnest(range(0, 1 + round(({F_MAX}::DOUBLE - {F_MIN}::DOUBLE) * 5 * span)::BIGINT)) / (5 * span) AS f FROM a WHERE span > 0),
q AS (SELECT sourceid, f, sum(w * cos(2 * pi() * f * t)) AS c, sum(w * sin(2 * pi() * f * t)) AS s, sum(w * y * y) AS yy, sum(w * y * cos(2 * pi() * f * t)) AS yc, sum(w * y * sin(2 * pi() * f * t)) AS ys,
  sum(w * cos(2 * pi() * f * t) * cos(2 * pi() * f * t)) AS cc, sum(w * cos(2 * pi() * f * t) * sin(2 * pi() * f * t)) AS cs FROM v JOIN fr USING (sourceid) GROUP BY ALL),
spec AS (SELECT sourceid, f, ((1 - cc - s * s) * yc * yc + (cc - c * c) * ys * ys - 2 * (cs - c * s) * yc * ys) / nullif(yy * ((cc - c * c) * (1 - cc - s * s) - (cs - c * s) * (cs - c * s)), 0) AS power,
  ((1 - cc) * c * c + cc * s * s - 2 * cs * c * s) / nullif(cc * (1 - cc) - cs * cs, 0) AS seen FROM q),
l AS (SELECT *, lag(power) OVER o AS pa, lead(power) OVER o AS pb FROM spec WINDOW o AS (PARTITION BY sourceid ORDER BY f)),
k AS (SELECT *, row_number() OVER (PARTITION BY sourceid ORDER BY power DESC, f) AS place FROM l WHERE power > pa AND power > pb),
b AS (SELECT k.*, n, (n - 3)::DOUBLE AS dg, dev, 1 - least(greatest(power, 0), 1 - 1e-15) AS rest FROM k JOIN a USING (sourceid) WHERE seen <= power QUALIFY row_number() OVER (PARTITION BY sourceid ORDER BY place) = 1),
e AS (SELECT *, power(rest, dg / 2) AS single, sqrt(2 / dg) * exp({_GAMMA.format(x='(dg / 2)')} - {_GAMMA.format(x='((dg - 1) / 2)')}) * {F_MAX} * sqrt(4 * pi()) * dev * power(rest, (dg - 1) / 2) * sqrt(dg / 2 * (1 - rest)) AS tau FROM b)
SELECT sourceid, n, round(f, 4) + 0.0 AS f, round(power, 5) + 0.0 AS power, place, CASE WHEN single + tau > 0 THEN round(log10(single - (1 - single) * (exp(-tau) - 1)), 4) + 0.0 END AS log10_fap FROM e""")
def ls_candidates(spark, d):
    """The frequency that each source's spectrum proposes, on its own grid with the survey's limits, and how likely noise would."""
    c = series.candidate_frequency(detections(spark, d), F_MIN, F_MAX)
    return c.select("sourceid", "n", r("f", 4).alias("f"), r("power", 5).alias("power"), F.col("place").cast("long").alias("place"), r("log10_fap", 4).alias("log10_fap"))

