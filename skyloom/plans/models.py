"""Periodic features, classifiers, publication, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import curves, fourier, imputing, learning, stats
from skyloom.operators.storage import new_folder
from skyloom.plans.registry import Registry, count, r
from skyloom.plans.statistics import clean
from skyloom.sources import files
from skyloom.sources.views import table
from skyloom.streaming import events as stream

query = Registry()
FEATURES = [f"e{k}" for k in range(64)]
#: Names of the bands in the catalogue of final_features.
BAND_NAMES = {5: "ks", 4: "h", 3: "j"}


def vectors(spark, d, n: int = 64):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(n)])


@query()
def periodic_features(spark, d):
    return fourier.periodic_features(clean(spark, d))


@query()
def final_features(spark, d):
    """Periodic features with each source's band means, colours free of reddening, how each band follows the fitted curve, phase differences and ratios of amplitudes."""
    lc = clean(spark, d)
    bands = lc.groupBy("sourceid").pivot("filterid", list(BAND_NAMES)).agg(stats.weighted_mean("mag", "emag"))
    bands = bands.withColumnsRenamed({str(k): f"{n}_mean_mag" for k, n in BAND_NAMES.items()})
    bands = bands.withColumns({"jk_excess": 0.01 * (F.col("sourceid") % 7), "hk_excess": 0.005 * (F.col("sourceid") % 7)})
    colours = {"JK_col": ("j_mean_mag", "ks_mean_mag", "jk_excess"), "HK_col": ("h_mean_mag", "ks_mean_mag", "hk_excess")}
    found = fourier.periodic_features(lc)
    orders = range(fourier.HARMONICS)
    fitted = found.select("sourceid", F.col("lsq_period").alias("period"), F.array(*[f"amp_{k}" for k in orders]).alias("amplitudes"), F.array(*[f"phi_{k}" for k in orders]).alias("phases"))
    scales = curves.against_bands(lc.where("filterid < 5"), fitted).groupBy("sourceid").pivot("filterid", [1, 2, 3, 4]).agg(F.first("nobs").alias("nobs"), F.first("model").alias("model"), F.first("scale").alias("scale"))
    scales = scales.withColumnsRenamed({f"{k}_{c}": f"{n}_{c}" for k, n in enumerate("ZYJH", 1) for c in ("nobs", "model", "scale")})
    return fourier.finalised(found, bands.join(scales, "sourceid", "left"), colours)


@query("WITH x AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(64)) + " FROM embeddings), p AS (SELECT " + ", ".join(f"quantile_cont(e{k}, 0.25) AS a{k}, quantile_cont(e{k}, 0.5) AS b{k}, quantile_cont(e{k}, 0.75) AS c{k}" for k in range(64)) + " FROM x) SELECT vec_id, " + ", ".join(f"round((e{k} - b{k}) / (c{k} - a{k}), 6) + 0.0 AS e{k}" for k in range(64)) + " FROM x, p")
def robust_scale(spark, d):
    return learning.robust_scale(vectors(spark, d), FEATURES).select("vec_id", *[r(c).alias(c) for c in FEATURES])


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT vec_id, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) + 0.0 AS weight FROM embeddings JOIN c USING (label)")
def balanced_weights(spark, d):
    return learning.balanced_weights(table(spark, d, "embeddings").select("vec_id", "label"), "label").select("vec_id", r("weight").alias("weight"))


@query()
def power_transform(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return learning.power_transform(lines, learning.fit_power(lines, ["price", "quantity"]))


@query()
def knn_impute(spark, d):
    """All 64 components; two of each vector's are taken away first."""
    v = vectors(spark, d)
    gone = lambda k: (F.pmod(F.xxhash64("vec_id"), F.lit(64)) == k) | (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(64)) == k)
    return imputing.knn_impute(v.select("vec_id", *[F.when(~gone(k), F.col(c)).alias(c) for k, c in enumerate(FEATURES)]), FEATURES, "vec_id")


@query()
def cv_predictions(spark, d):
    v = vectors(spark, d)
    return learning.cross_validated(v, lambda: learning.Forest(FEATURES, "label"), "vec_id", 10).select("vec_id", "label", "class", "prob", "fold")


@query()
def boosted_predictions(spark, d):
    """Each vector's class by boosted models that have not seen it: two halves by hash of the id."""
    v = vectors(spark, d)
    return learning.cross_validated(v, lambda: learning.Boosted(FEATURES, "label", id_col="vec_id"), "vec_id", 2).select("vec_id", "label", "class", "prob", "fold")


def labelled(spark, d):
    """Vectors as sources: half of the labels are constant, the first component less three stands for the false-alarm probability."""
    v = vectors(spark, d, 16).withColumn("log10_fap", -10 + 20 * F.col("e0"))
    return v.withColumns({"kind": F.when(F.col("label") < 5, "CONST").otherwise("VAR"), "type": F.when(F.col("label") < 5, "CONST").otherwise(F.col("label").cast("string"))})


@query()
def classify_cascade(spark, d):
    """Prepared models of two stages, trained on one half of the rows and applied to the other: variable or constant, then the class, with and without a significance cut."""
    v = labelled(spark, d)
    half = learning.fold("vec_id", 2)
    train, rest = v.where(half == 0), v.where(half == 1)
    made = lambda label: learning.Prepared(learning.Forest([*FEATURES[:16], "log10_fap"], label, "CONST", trees=20), id_col="vec_id", powered=["log10_fap"])
    first = made("kind").fit(train)
    cut, every = (made("type").fit(learning.with_significance(train, "type", c)) for c in (-10.0, float("inf")))
    out = learning.cascade(rest, first, cut, 0.5, second_nofap=every, constant="CONST")
    return out.select("vec_id", "label", "class", "prob", "prob_var", "prob_1st_stage", "class_nofap", "prob_nofap", "prob_var_nofap")


@query()
def models_by_cell(spark, d):
    """A forest for each of four cells, trained side by side and saved; each row is classified by its cell's."""
    v = vectors(spark, d, 16).withColumn("cell", F.when(F.col("e0") > 0, 2).otherwise(0) + F.when(F.col("e1") > 0, 1).otherwise(0))
    paths = learning.train_cells(v, "cell", lambda: learning.Forest([f"e{k}" for k in range(16)], "label", trees=10), new_folder(spark))
    models = {k: learning.Forest.load(path) for k, path in paths.items()}
    return learning.by_cell(v, "cell", models).select("vec_id", "cell", "label", "class", "prob")


@query("SELECT user_id AS sourceid, CASE WHEN event_type IN ('error', 'signup') THEN 'LPV' WHEN event_type = 'click' THEN 'RRcd' ELSE event_type END AS var_class, count(*)::INTEGER AS n_epochs, CAST(round(avg(value), 3) AS FLOAT) AS mean_mag FROM events GROUP BY FEATURES")
def publish_catalog(spark, d):
    """Relabelled classes, public names, narrow types and column descriptions."""
    named = F.when(F.col("event_type").isin("error", "signup"), "LPV").when(F.col("event_type") == "click", "RRcd").otherwise(F.col("event_type"))
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("sourceid"), named.alias("var_class")).agg(F.count("*").alias("ks_n"), F.round(F.avg("value"), 3).alias("ks_mean"))
    t = files.narrowed(t.withColumnsRenamed({"ks_n": "n_epochs", "ks_mean": "mean_mag"}), {"n_epochs": "int", "mean_mag": "float"})
    return t.withMetadata("mean_mag", {"unit": "mag", "description": "mean magnitude"})


@query("""SELECT user_id AS pixel, round(max(event_id) FILTER (event_type = 'view') / 8.0::DOUBLE, 4) + 0.0 AS seconds, max(event_id % 50) FILTER (event_type = 'click') AS n_candidates,
round(max(event_id) FILTER (event_type = 'view') / 8.0::DOUBLE / nullif(max(event_id % 50) FILTER (event_type = 'click'), 0), 5) + 0.0 AS per_curve FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def log_metrics(spark, d):
    """Log lines made from events, and the run metrics that they tell."""
    e = table(spark, d, "events")
    head = F.concat(F.col("ts").cast("string"), F.lit(" Healpix "), F.col("user_id").cast("string"))
    line = F.when(F.col("event_type") == "view", F.concat(head, F.lit(": finished, run in "), (F.col("event_id") / 8).cast("decimal(20,3)").cast("string"), F.lit("s: CONST:1")))
    line = line.when(F.col("event_type") == "click", F.concat(head, F.lit(": "), (F.col("event_id") % 50).cast("string"), F.lit("/100 variable candidates")))
    m = files.log_metrics(e.select(line.alias("value")).where("value IS NOT NULL"))
    return m.select("pixel", r("seconds", 4).alias("seconds"), "n_candidates", r("per_curve", 5).alias("per_curve"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(CAST(l_quantity AS FLOAT)::DOUBLE), 2) + 0.0 AS quantity FROM lineitem GROUP BY 1")
def csv_round_trip(spark, d):
    """Narrow columns through gzip CSV files and back; the second write finds the first and leaves it."""
    path = new_folder(spark)
    t = files.narrowed(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), {"l_quantity": "float"})
    files.write_csv(t, path)
    files.write_csv(t.limit(0), path)
    back = files.read_csv(spark, path, "l_orderkey long, l_quantity float, l_returnflag string")
    return back.groupBy("l_returnflag").agg(count().alias("n"), r(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def chunked_append(spark, d):
    path, c = new_folder(spark), table(spark, d, "customer")
    files.append_parts([c.where(F.col("c_custkey") % 3 == k) for k in range(3)], path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(count().alias("n"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """Sessions of each user over the stream of files."""
    out = stream.run_once(stream.sessions(stream.event_stream(spark, d)), new_folder(spark))
    named = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", named("start"), named("stop"), "n")


@query("SELECT user_id, count(*) AS n, round(sum(value / power(0.05 + 0.001 * value, 2)) / sum(1 / power(0.05 + 0.001 * value, 2)), 6) + 0.0 AS mean FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_moments(spark, d):
    """Weighted mean of each user so far, from sums that the stream keeps."""
    events = stream.event_stream(spark, d).where("value IS NOT NULL").withColumn("error", 0.05 + 0.001 * F.col("value"))
    out = stream.run_once(stream.running_moments(events), new_folder(spark))
    return out.select("user_id", "n", r("mean").alias("mean"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY FEATURES")
def stream_window_counts(spark, d):
    out = stream.run_once(stream.window_counts(stream.event_stream(spark, d)), new_folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", r("mean").alias("mean"))
