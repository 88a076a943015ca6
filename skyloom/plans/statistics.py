"""Light-curve moments, histograms, binned statistics, clipping and scalar features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.operators import quality, stats
from skyloom.operators.quantiles import exact_percentiles
from skyloom.plans.registry import Registry, count, r
from skyloom.sources.views import DETECTIONS, detections, table

query = Registry()

CUT = DETECTIONS + """, cut AS (SELECT * FROM lc WHERE NOT coalesce(chi > 5 AND mag < 13.2, false) AND NOT coalesce(ast_res_chisq > 11.829, false) AND NOT coalesce(emag <= 0, false) AND NOT ambiguous_match),
p AS (SELECT sourceid, 0.5 * (quantile_cont(mag, 0.84) - quantile_cont(mag, 0.16)) AS s, median(mag) AS m FROM cut GROUP BY 1),
clip AS (SELECT cut.* FROM cut JOIN p USING (sourceid) WHERE CASE WHEN s > 0 THEN abs(mag - m) / s < 5 ELSE true END)"""


def clean(spark, d):
    return quality.sigma_clip(quality.quality_cut(detections(spark, d)), threshold=5.0)


@query(f"""WITH {CUT}, a AS (SELECT sourceid, count(mag) AS n, min(mag) AS lo, max(mag) AS hi, avg(mag) AS mean, var_samp(mag) AS var, stddev_pop(mag) AS sd,
    avg(mag * mag * mag) AS m3, avg(mag * mag) AS m2, kurtosis_pop(mag) AS kurt, median(mag) AS med, sum(mag / (emag * emag)) / sum(1 / (emag * emag)) AS ivw FROM clip GROUP BY 1),
b AS (SELECT sourceid, avg(CASE WHEN mag > mean - sd AND mag < mean + sd THEN 0 ELSE 1 END) AS beyond, median(mag - med) AS dev, avg(power(mag - mean, 3)) AS c3 FROM clip JOIN a USING (sourceid) GROUP BY 1)
SELECT sourceid, c_name, n, round(lo, 6) + 0.0 AS "min", round(hi, 6) + 0.0 AS "max", round(mean, 6) + 0.0 AS mean, round(var, 4) + 0.0 AS var, round(c3 / power(sd, 3), 6) + 0.0 AS skew,
    round(kurt, 6) + 0.0 AS kurt, round((hi - lo) / 2, 6) + 0.0 AS amplitude, round(ivw, 6) + 0.0 AS ivw_mean, round(beyond, 6) + 0.0 AS beyondfrac, round(dev, 6) + 0.0 AS med_magdev
FROM a JOIN b USING (sourceid) JOIN customer ON sourceid = c_custkey""")
def lc_moments(spark, d):
    """Quality cut, sigma clip and moments of each light curve, with its source's name."""
    m = stats.moments(clean(spark, d)).join(table(spark, d, "customer").select(F.col("c_custkey").alias("sourceid"), "c_name"), "sourceid")
    names = ("min", "max", "mean", "skew", "kurt", "amplitude", "ivw_mean", "beyondfrac", "med_magdev")
    return m.select("sourceid", "c_name", "n", r("var", 4).alias("var"), *[r(c).alias(c) for c in names])


@query(f"WITH {CUT} SELECT filterid, (SELECT count(*) FROM lc l WHERE l.filterid = clip.filterid) AS n_all, count(*) AS n_kept FROM clip GROUP BY 1")
def quality_counts(spark, d):
    every = detections(spark, d).groupBy("filterid").agg(count().alias("n_all"))
    return every.join(clean(spark, d).groupBy("filterid").agg(count().alias("n_kept")), "filterid")


PCT = "(SELECT user_id AS sourceid, " + ", ".join(f"quantile_cont(value, {p / 100}) AS v_p{p}" for p in (0, 1, 5, 16, 25, 75, 84, 95, 99, 100)) + " FROM events GROUP BY 1)"


@query("SELECT sourceid, " + ", ".join(f"round(v_p{a} - v_p{b}, 6) + 0.0 AS v_p{a}_p{b}" for a, b in ((75, 25), (84, 16), (95, 5), (99, 1), (100, 0))) + f" FROM {PCT}")
def pct_ranges(spark, d):
    marks = (0, 1, 5, 16, 25, 75, 84, 95, 99, 100)
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("sourceid")).agg(F.percentile("value", F.array(*[F.lit(m / 100) for m in marks])).alias("p"))
    gaps = expr.percentile_gaps("v")
    named = p.select("sourceid", *[F.col("p")[k].alias(f"v_p{m}") for k, m in enumerate(marks)])
    wide = named.select("sourceid", *gaps)
    return wide.select("sourceid", *[r(c).alias(c) for c in wide.columns[1:]])


RATIOS = ["stdev", "mad", "p75_p25", "p84_p16", "p95_p5", "p99_p1", "p100_p0"]
_MARKS = (0, 1, 5, 16, 25, 75, 84, 95, 99, 100)


@query(f"""WITH {DETECTIONS}, m AS (SELECT *, median(mag) OVER (PARTITION BY sourceid) AS med FROM lc),
g AS (SELECT sourceid, stddev_samp(mag) AS stdev, median(abs(mag - med)) AS mad, sqrt(1 / sum(1 / (emag * emag))) * sqrt(count(*)) AS me, sum((mag - med) / emag) AS j, count(*) AS n,
    """ + ", ".join(f"quantile_cont(mag, {p / 100}) AS p{p}" for p in _MARKS) + """ FROM m GROUP BY 1),
w AS (SELECT *, """ + ", ".join(f"p{a} - p{b} AS p{a}_p{b}" for a, b in ((75, 25), (84, 16), (95, 5), (99, 1), (100, 0))) + """ FROM g)
SELECT sourceid, round(me, 6) + 0.0 AS ks_mean_error, round(j / nullif(n - 1, 0), 4) + 0.0 AS ks_stetson_j, """ + ", ".join(f"round({c} / nullif(me, 0), 4) + 0.0 AS ks_{c}_over_error" for c in RATIOS) + " FROM w")  # fmt: skip
def catalogue_statistics(spark, d):
    """A catalogue's statistics of each source through the whole preprocessing: gaps, all seven ratios, scaled index."""
    from pyspark.sql import Window

    m = detections(spark, d).withColumn("med", F.median("mag").over(Window.partitionBy("sourceid")))
    g = m.groupBy("sourceid").agg(
        F.stddev_samp("mag").alias("ks_stdev"), F.median(F.abs(F.col("mag") - F.col("med"))).alias("ks_mad"), F.sqrt(1 / F.sum(1 / (F.col("emag") * F.col("emag")))).alias("ks_b_ivw_err_mag"),
        F.count("*").alias("ks_n_b_phot"), F.sum((F.col("mag") - F.col("med")) / F.col("emag")).alias("ks_stetson_j"), F.count("*").alias("ks_n_epochs"), F.percentile("mag", F.array(*[F.lit(p / 100) for p in _MARKS])).alias("p"),
    )
    named = g.select("*", *[F.col("p")[k].alias(f"ks_p{p}") for k, p in enumerate(_MARKS)])
    out = stats.preprocessed(named)
    return out.select("sourceid", r("ks_mean_error").alias("ks_mean_error"), r("ks_stetson_j", 4).alias("ks_stetson_j"), *[r(f"ks_{c}_over_error", 4).alias(f"ks_{c}_over_error") for c in RATIOS])


@query(f"""WITH {DETECTIONS}, g AS (SELECT sourceid, sqrt(1 / sum(1 / (emag * emag))) * sqrt(count(*)) AS me, stddev_samp(mag) AS sd, quantile_cont(mag, .75) - quantile_cont(mag, .25) AS iqr,
    sum(mag / emag) AS j, count(*) AS n FROM lc GROUP BY 1)
SELECT sourceid, round(me, 6) + 0.0 AS mean_error, round(sd / nullif(me, 0), 5) + 0.0 AS sd_ratio, round(iqr / nullif(me, 0), 5) + 0.0 AS iqr_ratio, round(j / nullif(n - 1, 0), 4) + 0.0 AS stetson FROM g""")
def error_ratios(spark, d):
    g = detections(spark, d).groupBy("sourceid").agg(
        (F.sqrt(1 / F.sum(1 / (F.col("emag") * F.col("emag")))) * F.sqrt(F.count("*"))).alias("me"), F.stddev_samp("mag").alias("sd"),
        F.percentile("mag", F.array(F.lit(0.25), F.lit(0.75))).alias("p"), F.sum(F.col("mag") / F.col("emag")).alias("j"), F.count("*").alias("n"),
    )
    return g.select("sourceid", r("me").alias("mean_error"), r(expr.ratio("sd", "me"), 5).alias("sd_ratio"), r(expr.ratio(F.col("p")[1] - F.col("p")[0], "me"), 5).alias("iqr_ratio"), r(expr.ratio("j", F.col("n") - 1), 4).alias("stetson"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice / nullif(l_discount * l_discount, 0)) / sum(CASE WHEN l_extendedprice IS NOT NULL THEN 1 / nullif(l_discount * l_discount, 0) END), 4) + 0.0 AS ivw
FROM lineitem GROUP BY ALL""")
def ivw_by_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(count().alias("n"), r(stats.weighted_mean("l_extendedprice", "l_discount"), 4).alias("ivw"))


def _hist(weight: str) -> str:
    return f"""WITH h AS (SELECT least(floor((o_totalprice - 0) / 10000.0::DOUBLE), 49)::BIGINT AS bin, sum({weight}) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1),
f AS (SELECT b AS bin, coalesce(n, 0) AS n FROM range(50) t(b) LEFT JOIN h ON b = bin)
SELECT bin, round(n, 4) + 0.0 AS n, round(n / (sum(n) OVER () * 10000.0::DOUBLE), 12) + 0.0 AS density, round(sum(n) OVER (ORDER BY bin), 4) + 0.0 AS cumulative FROM f"""


def _rounded(h):
    return h.select("bin", r("n", 4).alias("n"), r("density", 12).alias("density"), r("cumulative", 4).alias("cumulative"))


@query(_hist("1.0::DOUBLE"))
def hist1d(spark, d):
    return _rounded(stats.histogram(table(spark, d, "orders"), "o_totalprice", 0, 500_000, 50))


@query(_hist("(o_custkey % 7)::DOUBLE"))
def hist1d_weighted(spark, d):
    return _rounded(stats.histogram(table(spark, d, "orders"), "o_totalprice", 0, 500_000, 50, (F.col("o_custkey") % 7).cast("double")))


@query("""WITH c AS (SELECT least(floor(l_quantity / 5.0::DOUBLE), 9)::BIGINT AS x_bin, least(floor(l_extendedprice / 10000.0::DOUBLE), 9)::BIGINT AS y_bin, count(*) AS n FROM lineitem
WHERE l_quantity BETWEEN 0 AND 50 AND l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1, 2)
SELECT x_bin, y_bin, n, round(n / max(n) OVER (PARTITION BY x_bin), 6) + 0.0 AS col_norm, round(n / sum(n) OVER (PARTITION BY y_bin), 6) + 0.0 AS row_norm FROM c""")
def hist2d_norm(spark, d):
    h = stats.histogram_2d(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", (0, 50, 10), (0, 100_000, 10))
    return h.select("x_bin", "y_bin", "n", r("col_norm").alias("col_norm"), r("row_norm").alias("row_norm"))


EDGES = "q AS (SELECT quantile_cont(o_totalprice, [" + ", ".join(repr(0.005 + (0.995 - 0.005) * k / 12) for k in range(13)) + "]) AS v FROM orders), e AS (SELECT k - 1 AS bin, v[k] AS lo, v[k + 1] AS hi FROM q, range(1, 13) t(k))"


@query(f"""WITH {EDGES} SELECT bin, round((lo + hi) / 2, 4) + 0.0 AS centre, count(*) AS n, round(quantile_cont(o_custkey, 0.16), 4) + 0.0 AS p16, round(quantile_cont(o_custkey, 0.5), 4) + 0.0 AS median,
round(quantile_cont(o_custkey, 0.84), 4) + 0.0 AS p84 FROM e JOIN orders ON o_totalprice > lo AND o_totalprice < hi GROUP BY bin, lo, hi""")
def running_median(spark, d):
    """Equal-count bins; both edges are outside."""
    o = table(spark, d, "orders")
    m = stats.running_statistic(o, "o_totalprice", "o_custkey", stats.equal_count_edges(o, "o_totalprice", 12))
    return m.select(F.col("bin").cast("long").alias("bin"), "n", *[r(c, 4).alias(c) for c in ("centre", "p16", "median", "p84")])


@query(f"""WITH {EDGES}, k AS (SELECT bin, (lo + hi) / 2 AS x, quantile_cont(o_custkey, 0.5) AS y FROM e JOIN orders ON o_totalprice > lo AND o_totalprice < hi GROUP BY bin, lo, hi),
s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, row_number() OVER (ORDER BY x) AS n FROM k)
SELECT o_orderkey, round(CASE WHEN x1 IS NULL OR o_totalprice <= x0 THEN y0 ELSE y0 + (y1 - y0) * (o_totalprice - x0) / (x1 - x0) END, 4) + 0.0 AS level
FROM orders JOIN s ON (n = 1 OR o_totalprice >= x0) AND (x1 IS NULL OR o_totalprice < x1)
WHERE o_custkey < CASE WHEN x1 IS NULL OR o_totalprice <= x0 THEN y0 ELSE y0 + (y1 - y0) * (o_totalprice - x0) / (x1 - x0) END""")
def constant_selection(spark, d):
    """Rows below the interpolated running median of their bin."""
    o = table(spark, d, "orders")
    knots = stats.running_statistic(o, "o_totalprice", "o_custkey", stats.equal_count_edges(o, "o_totalprice", 12))
    level = stats.interpolate(o, "o_totalprice", knots, "centre", "median", "level")
    return level.where("o_custkey < level").select("o_orderkey", r("level", 4).alias("level"))


@query("""WITH b AS (SELECT least(floor(o_totalprice / 25000.0::DOUBLE), 19)::BIGINT AS bin, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hit FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1)
SELECT bin, n, hit, round(hit / n, 6) + 0.0 AS completeness, round(sqrt(hit / n * (1 - hit / n) / n), 6) + 0.0 AS error, round(sum(hit) OVER w / sum(n) OVER w, 6) + 0.0 AS cumulative FROM b WINDOW w AS (ORDER BY bin)""")
def completeness_curve(spark, d):
    b = table(spark, d, "orders").groupBy(stats.equal_width("o_totalprice", 0, 500_000, 20).alias("bin")).agg(count().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("hit")).where("bin IS NOT NULL")
    p, w = F.col("hit") / F.col("n"), Window.orderBy("bin")
    return b.select("bin", "n", "hit", r(p).alias("completeness"), r(F.sqrt(p * (1 - p) / F.col("n"))).alias("error"), r(F.sum("hit").over(w) / F.sum("n").over(w)).alias("cumulative"))


FEATS = ("l_extendedprice", "l_quantity")


@query("WITH b AS (SELECT " + ", ".join(f"median({c}) AS m_{c}, 0.25 * (quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)) AS s_{c}" for c in FEATS) + """ FROM lineitem)
SELECT l_returnflag, count(*) AS n FROM lineitem, b WHERE """ + " AND ".join(f"{c} BETWEEN m_{c} - 2 * s_{c} AND m_{c} + 2 * s_{c}" for c in FEATS) + " GROUP BY 1")
def feature_clip(spark, d):
    return quality.feature_clip(table(spark, d, "lineitem"), list(FEATS), 2.0).groupBy("l_returnflag").agg(count().alias("n"))


@query("""WITH a AS (SELECT * FROM lineitem WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.001) FROM lineitem) AND l_extendedprice < (SELECT quantile_cont(l_extendedprice, 0.999) FROM lineitem))
SELECT l_linestatus, count(*) AS n FROM a WHERE l_quantity > (SELECT quantile_cont(l_quantity, 0.001) FROM a) AND l_quantity < (SELECT quantile_cont(l_quantity, 0.999) FROM a) GROUP BY 1""")
def percentile_trim(spark, d):
    return quality.percentile_trim(table(spark, d, "lineitem"), list(FEATS)).groupBy("l_linestatus").agg(count().alias("n"))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS corr_qp, round(covar_samp(l_quantity, l_discount), 8) + 0.0 AS cov_qd, round(corr(l_discount, l_tax), 6) + 0.0 AS corr_dt FROM lineitem""")
def feature_correlations(spark, d):
    return table(spark, d, "lineitem").agg(r(F.corr("l_quantity", "l_extendedprice")).alias("corr_qp"), r(F.covar_samp("l_quantity", "l_discount"), 8).alias("cov_qd"), r(F.corr("l_discount", "l_tax")).alias("corr_dt"))


@query("""SELECT round((median(l_extendedprice) FILTER (l_returnflag = 'R') - median(l_extendedprice) FILTER (l_returnflag = 'N')) / stddev_pop(l_extendedprice), 6) + 0.0 AS price,
round((median(l_quantity) FILTER (l_returnflag = 'R') - median(l_quantity) FILTER (l_returnflag = 'N')) / stddev_pop(l_quantity), 6) + 0.0 AS quantity FROM lineitem""")
def median_shift(spark, d):
    """Difference of two classes' medians in deviations; the medians of all rows of a class are found in bounded memory."""
    lines, names = table(spark, d, "lineitem"), ("l_extendedprice", "l_quantity")
    split = lines.select([F.when(F.col("l_returnflag") == k, F.col(c)).alias(f"{c}_{k}") for c in names for k in "RN"])
    m = exact_percentiles(split, split.columns, [0.5])
    gap = lambda c: F.lit(m[f"{c}_R"][0]).cast("double") - F.lit(m[f"{c}_N"][0]).cast("double")
    return lines.agg(*[r(gap(c) / F.stddev_pop(c)).alias(n) for c, n in zip(names, ("price", "quantity"), strict=True)])


@query("""SELECT event_type, round(1 - sqrt(power(avg(cos(2 * pi() * hour(ts) / 24)), 2) + power(avg(sin(2 * pi() * hour(ts) / 24)), 2)), 6) + 0.0 AS circular_variance FROM events GROUP BY 1""")
def circular_variance(spark, d):
    a = expr.TWO_PI * F.hour("ts") / 24
    return table(spark, d, "events").groupBy("event_type").agg(r(1 - F.sqrt(F.pow(F.avg(F.cos(a)), 2) + F.pow(F.avg(F.sin(a)), 2))).alias("circular_variance"))


@query("""WITH g AS (SELECT o_custkey % 10 AS field, count(*) FILTER (o_orderstatus = 'F') / count(*) AS rate, count(*) AS n FROM orders GROUP BY 1)
SELECT round(avg(rate), 6) + 0.0 AS mean, round(median(rate), 6) + 0.0 AS median, round(avg(sqrt(rate * (1 - rate) / n)), 6) + 0.0 AS error FROM g""")
def ensemble_metrics(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey") % 10).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.count("*").alias("n"))
    return g.agg(r(F.avg("rate")).alias("mean"), r(F.median("rate")).alias("median"), r(F.avg(F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))).alias("error"))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS n, p_retailprice / 100 AS j, p_retailprice / 130 AS k, p_brand FROM part)
SELECT p_partkey, round(log10(sqrt(n) / j), 6) + 0.0 AS g_amp, round(j - k - 0.3, 6) + 0.0 AS colour, round(sqrt(power(n / 100, 2) * 2.25 + 0.25 * power(n / 50, 2) + 0.01 * power(j - k, 2)), 6) + 0.0 AS colour_error,
round(k + 0.01 * (j - k) - 0.2, 6) + 0.0 AS k_other, round(j / 50 + 0.03 - 1 / nullif(n, 0), 6) + 0.0 AS residual, CASE WHEN n < 50 THEN round(log10(1 - n / 50), 6) + 0.0 END AS log_rest,
CASE split_part(p_brand, '#', 1) WHEN 'Brand' THEN 'B' || split_part(p_brand, '#', 2) END AS short_id FROM p""")
def scalar_features(spark, d):
    """Amplitude, colour, errors, transforms and ids as plain expressions."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("n"), (F.col("p_retailprice") / 100).alias("j"), (F.col("p_retailprice") / 130).alias("k"), "p_brand")
    p = p.withColumns({"jk": F.col("j") - F.col("k"), "ejk": F.lit(0.3), "ea": F.col("n") / 100, "eb": F.col("n") / 50, "plx": F.col("j") / 50})
    return p.select(
        "p_partkey", r(expr.log_amplitude("n", "j")).alias("g_amp"), r(expr.dereddened("j", "k", "ejk")).alias("colour"), r(expr.colour_error("ea", "eb", "jk", 0.5, 0.1)).alias("colour_error"),
        r(expr.linear_mix("k", "jk", 0.01, -0.2)).alias("k_other"), r(expr.parallax_residual("plx", "n", -0.03)).alias("residual"), r(expr.log_complement(F.col("n") / 50)).alias("log_rest"),
        expr.translated_id("p_brand", "#", {"Brand": "B"}).alias("short_id"),
    )


@query("""SELECT prob_bin, n, round(share, 6) + 0.0 AS share FROM (SELECT CASE WHEN l_discount > 0.065 THEN 'sure' WHEN l_discount > 0.03 THEN 'likely' ELSE 'unsure' END AS prob_bin, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
FROM lineitem WHERE l_returnflag <> 'A' AND l_tax IS NOT NULL GROUP BY 1)""")
def threshold_filter(spark, d):
    """Classes by probability thresholds after exclusions."""
    from skyloom.operators.quality import _true

    kept = table(spark, d, "lineitem").where(~_true(F.col("l_returnflag") == "A")).dropna(subset=["l_tax"])
    named = F.when(F.col("l_discount") > 0.065, "sure").when(F.col("l_discount") > 0.03, "likely").otherwise("unsure")
    g = kept.groupBy(named.alias("prob_bin")).agg(count().alias("n"))
    return g.select("prob_bin", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
