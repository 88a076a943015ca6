"""Grouped, weighted, binned and cumulative statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.expr import col, finite, percentile_gaps, ratio
from skyloom.operators.ordering import numbered
from skyloom.operators.quantiles import exact_percentiles, grouped_percentiles
from skyloom.operators.storage import durable, small


def weighted_mean(value: str | Column, error: str | Column) -> Column:
    """Inverse-variance weighted mean; rows with a null or zero error don't count."""
    w = F.try_divide(F.lit(1.0), col(error) * col(error))
    return F.try_divide(F.sum(col(value) * w), F.sum(F.when(col(value).isNotNull(), w)))


def moments(df: DataFrame, key: str = "sourceid", value: str = "mag", error: str = "emag") -> DataFrame:
    """Per group: n, extremes, mean, sample variance, population skewness and excess kurtosis, half range, weighted mean, share outside one deviation, median of the deviations from the median."""
    v = F.col(value)
    group = Window.partitionBy(key)
    # one exchange: the second look at each group is a window over the rows that the sums then go through
    rows = df.withColumns({"_mean": F.avg(v).over(group), "_sd": F.stddev_pop(v).over(group), "_median": F.median(v).over(group)})
    inside = (v > F.col("_mean") - F.col("_sd")) & (v < F.col("_mean") + F.col("_sd"))
    return rows.groupBy(key).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"), ((F.max(v) - F.min(v)) / 2).alias("amplitude"), weighted_mean(value, error).alias("ivw_mean"),
        F.first("_median").alias("median"), F.avg((~inside).cast("double")).alias("beyondfrac"), F.median(v - F.col("_median")).alias("med_magdev"),
    )


def with_error_ratios(df: DataFrame, band: str = "ks") -> DataFrame:
    """``df`` with the mean error, the standard error of the weighted mean times the root of its points, and the ratios to it of deviation, median deviation and five percentile gaps."""
    error = F.col(f"{band}_b_ivw_err_mag") * F.sqrt(f"{band}_n_b_phot")
    spreads = [f"{band}_stdev", f"{band}_mad", *[f"{band}_{gap}" for gap in ("p75_p25", "p84_p16", "p95_p5", "p99_p1", "p100_p0")]]
    return df.withColumn(f"{band}_mean_error", error).withColumns({f"{c}_over_error": ratio(c, f"{band}_mean_error") for c in spreads})


def preprocessed(df: DataFrame, band: str = "ks") -> DataFrame:
    """Catalogue statistics as classifiers take them: percentile gaps, then ratios to the mean error, then Stetson's J over the epochs less one."""
    gaps = df.select("*", *percentile_gaps(band))
    return with_error_ratios(gaps, band).withColumn(f"{band}_stetson_j", ratio(f"{band}_stetson_j", F.col(f"{band}_n_epochs") - 1))


def equal_width(c: str | Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0; the last bin holds its upper edge; null outside."""
    c = col(c)
    return F.when((c >= low) & (c <= high), F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1))).cast("long")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, weight: str | Column | None = None) -> DataFrame:
    """bin, n (or the sum of weights), density, cumulative; empty bins are listed."""
    w = F.lit(1.0) if weight is None else col(weight)
    counted = df.select(equal_width(value, low, high, bins).alias("bin"), w.alias("_w")).where("bin IS NOT NULL").groupBy("bin").agg(F.sum("_w").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    filled = every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0.0)).alias("n"))
    whole = Window.partitionBy()
    return filled.withColumn("density", ratio("n", F.sum("n").over(whole) * ((high - low) / bins))).withColumn("cumulative", F.sum("n").over(whole.orderBy("bin")))


def histogram_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float, int], y_range: tuple[float, float, int]) -> DataFrame:
    """x_bin, y_bin, n, share of the column's maximum, share of the row's sum, for cells that hold rows."""
    cells = df.select(equal_width(x, *x_range).alias("x_bin"), equal_width(y, *y_range).alias("y_bin")).dropna().groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
    return cells.withColumn("col_norm", ratio("n", F.max("n").over(Window.partitionBy("x_bin")))).withColumn("row_norm", ratio("n", F.sum("n").over(Window.partitionBy("y_bin"))))


def equal_count_edges(df: DataFrame, value: str, bins: int, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """bin, lo, hi: consecutive percentiles; one row per bin."""
    marks = exact_percentiles(df, [value], [low + (high - low) * k / bins for k in range(bins + 1)])[value]
    rows = [F.struct(F.lit(k).alias("bin"), F.lit(marks[k]).cast("double").alias("lo"), F.lit(marks[k + 1]).cast("double").alias("hi")) for k in range(bins)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def running_statistic(df: DataFrame, x: str, y: str, edges: DataFrame) -> DataFrame:
    """Per bin that holds rows: centre, count and percentiles of y over rows strictly inside the edges. ``edges`` has a row for each of a few bins."""
    binned = df.join(small(edges, 32), (F.col(x) > F.col("lo")) & (F.col(x) < F.col("hi"))).select("bin", F.col(y).alias("_y"))
    # read by every narrowing pass
    binned = durable(binned)
    found = grouped_percentiles(binned, "bin", "_y", [0.16, 0.5, 0.84])
    kinds = "array<struct<bin:bigint,p16:double,median:double,p84:double>>"
    rows = [F.struct(F.lit(k).alias("bin"), *[F.lit(v).alias(c) for c, v in zip(("p16", "median", "p84"), p, strict=True)]) for k, p in found.items()]
    marks = df.sparkSession.range(1).select(F.inline(F.array(*rows).cast(kinds)))
    n = binned.groupBy("bin").agg(F.count("*").alias("n"))
    return edges.join(n, "bin").join(F.broadcast(marks), "bin", "left").select("bin", ((F.col("lo") + F.col("hi")) / 2).alias("centre"), "n", "p16", "median", "p84")


def interpolate(df: DataFrame, x: str, knots: DataFrame, knot_x: str, knot_y: str, out: str) -> DataFrame:
    """Piecewise linear value of the knots at x, constant beyond the ends. ``knots`` is small."""
    order = Window.orderBy(knot_x)
    k = knots.select(F.col(knot_x).alias("_x0"), F.col(knot_y).alias("_y0"), F.lead(knot_x).over(order).alias("_x1"), F.lead(knot_y).over(order).alias("_y1"), F.row_number().over(order).alias("_k"))
    at = F.col(x)
    inside = ((F.col("_k") == 1) | (at >= F.col("_x0"))) & (F.col("_x1").isNull() | (at < F.col("_x1")))
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (at - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    value = F.when(F.col("_x1").isNull() | (at <= F.col("_x0")), F.col("_y0")).otherwise(line)
    return df.join(small(k, 48), inside, "left").withColumn(out, value).drop("_x0", "_y0", "_x1", "_y1", "_k")


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall."""
    pairs = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    rows = pairs.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    cols = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("called"))
    return rows.join(cols, "class", "full").select("class", F.coalesce("support", F.lit(0)).alias("support"), ratio(F.coalesce("hits", F.lit(0)), "called").alias("precision"), ratio("hits", "support").alias("recall"))


def first_by_priority(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union by name of ``parts``; of rows with the same key the earliest part's stays (one of them)."""
    tagged = [p.withColumn("_rank", F.lit(k)) for k, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_rank"))).where("_n = 1").drop("_rank", "_n")


def keep_best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def fallback(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """``first`` and those rows of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))


def patched(base: DataFrame, patch: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``base`` with nulls of ``columns`` filled from ``patch`` by key."""
    renamed = patch.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = base.join(renamed, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_{c}"))
    return out.drop(*[f"_{c}" for c in columns])


def products(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, n, x, y, xx, yy, xy: over the rows that have both columns, their number and the sums of both, of their squares and of their product (i up to j).

    Each task multiplies its batches as matrices and passes on one row a pair, so wide tables need neither an aggregate a pair nor a row a pair and row.
    NaN and infinities count as null. The caller centres the columns where sums of squares would cancel.
    """
    size = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, size, size))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            seen = np.isfinite(x)
            x, m = np.where(seen, x, 0.0), seen.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(size)
        if total[0].any():
            yield pd.DataFrame({"i": i, "j": j, **dict(zip(("n", "x", "y", "xx", "yy", "xy"), total[:, i, j], strict=True))})

    wide = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    parts = wide.mapInPandas(run, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def _named(columns: list[str]) -> list[Column]:
    names = F.array(*[F.lit(c) for c in columns])
    return [names[F.col("i")].alias("a"), names[F.col("j")].alias("b")]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, covariance, correlation of every pair of columns (a before b, or the same), each over the rows that have both.

    Two passes: the means, then products about them. Fewer than two rows give no covariance, a constant column no correlation;
    pairs never seen together, and all pairs of an empty table, give no row.
    """
    about = df.agg(*[F.avg(finite(c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    off = df.select(*[(F.col(c).cast("double") - F.lit(about[k])).alias(c) for k, c in enumerate(columns)])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    own = lambda s, a, b: F.col(s) - a * b / n
    spread = F.sqrt(own("xx", x, x) * own("yy", y, y))
    return products(off, columns).where("n > 0").select(*_named(columns), ratio(own("xy", x, y), n - 1).alias("covariance"), ratio(own("xy", x, y), spread).alias("correlation"))


def circular_covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, covariance of angles in radians: the circular variance of each, and of each pair the circular correlation times the root of both variances.

    Angles without any value have a variance of null and no pairs.
    """
    ends = df.agg(*[f(g(finite(c))).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f, g in (("s", F.avg, F.sin), ("c", F.avg, F.cos))]).first()
    mean = [(ends[2 * k], ends[2 * k + 1]) for k in range(len(columns))]
    known = [k for k, m in enumerate(mean) if None not in m]
    off = df.select(*[F.sin(F.col(c).cast("double") - (math.atan2(*mean[k]) if k in known else 0.0)).alias(c) for k, c in enumerate(columns)])
    sums = products(off, columns).select("i", "j", "xy")
    var = F.array(*[F.lit(1 - math.hypot(*m)) if k in known else F.lit(None).cast("double") for k, m in enumerate(mean)])
    own = F.broadcast(sums.where("i = j").select("i", F.col("xy").alias("square")))
    pairs = sums.where("i < j").join(own.withColumnRenamed("square", "si"), "i").join(own.select(F.col("i").alias("j"), F.col("square").alias("sj")), "j")
    corr = ratio("xy", F.sqrt(F.col("si") * F.col("sj")))
    cross = pairs.select(*_named(columns), (corr * F.sqrt(var[F.col("i")] * var[F.col("j")])).alias("covariance"))
    alone = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"))
    return alone.select(*_named(columns), var[F.col("i")].alias("covariance")).unionByName(cross)


def class_profiles(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """label, feature, score, importance, weighted: the mean standard score of each feature by class, the share of its variance that classes explain, and their product.

    Both are linear in the classes' means, so one aggregate by class is all that reads rows. A constant feature has neither.
    """
    g = df.groupBy(label).agg(F.count("*").alias("_n"), *[f(F.col(c)).alias(f"_{n}{k}") for k, c in enumerate(features) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_n{k}").alias("n"), F.col(f"_m{k}").alias("m"), F.col(f"_v{k}").alias("v")) for k, c in enumerate(features)])
    cells = g.select(label, F.inline(cells)).where("n > 0")
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    mean = cells.groupBy("feature").agg((F.sum(n * m) / F.sum(n)).alias("mean"), F.sum(n).alias("all"))
    about = cells.join(mean, "feature")
    off = m - F.col("mean")
    parts = about.groupBy("feature").agg((F.sum(n * off * off) / F.first("all")).alias("between"), (F.sum(n * v) / F.first("all")).alias("within"))
    every = F.col("between") + F.col("within")
    out = about.join(parts, "feature").select(label, "feature", ratio(off, F.sqrt(every)).alias("score"), ratio("between", every).alias("importance"))
    return out.withColumn("weighted", F.col("score") * F.col("importance"))


def confusion_shares(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n and its share of the true class, for any number of classes."""
    n = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return n.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy(truth))))


def drawn(df: DataFrame, n: int, key: str, salt: str) -> DataFrame:
    """``n`` rows drawn with replacement: ``df`` and ``draw``, from 0. Position and draw meet by a hash, so reruns agree."""
    rows = numbered(df, F.col(key), name="_position")
    size = max(1, df.count())
    digest = F.md5(F.concat(F.lit(salt), F.col("id").cast("string")))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % size).alias("_position"))
    return draws.join(rows, "_position").drop("_position")


def density_weight(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``df`` with ``weight``: the inverse of its own histogram, interpolated between bin centres, of one row at least."""
    width = (high - low) / bins
    n = df.select(equal_width(value, low, high, bins).alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("n"))
    knots = df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(n, "bin", "left").select((low + width * (F.col("bin") + 0.5)).alias("centre"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    return interpolate(df, value, knots, "centre", "n", "_density").withColumn("weight", 1 / F.greatest(F.lit(1.0), F.col("_density"))).drop("_density")
