"""Matrices of features, samples drawn for training, tolerance tests, and tables by file."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.operators import stats
from skyloom.operators.storage import new_folder
from skyloom.plans.registry import Registry, count, r
from skyloom.sources import files
from skyloom.sources.views import DETECTIONS, SKY, detections, sky, table

query = Registry()
#: All components of a vector.
NAMES = [f"e{k}" for k in range(64)]
CELLS = "v AS (SELECT vec_id, label, k, CAST(embedding[k + 1] AS DOUBLE) AS x FROM embeddings, range(64) t(k))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(NAMES)])


@query(f"WITH {CELLS} SELECT 'e' || p.k AS a, 'e' || q.k AS b, round(covar_samp(p.x, q.x), 6) + 0.0 AS covariance, round(corr(p.x, q.x), 6) + 0.0 AS correlation FROM v p JOIN v q ON p.vec_id = q.vec_id AND p.k <= q.k GROUP BY p.k, q.k")
def correlation_matrix(spark, d):
    m = stats.correlations(vectors(spark, d), NAMES)
    return m.select("a", "b", r("covariance").alias("covariance"), r("correlation").alias("correlation"))


@query(f"""WITH {CELLS}, m AS (SELECT k, atan2(avg(sin(x)), avg(cos(x))) AS m, 1 - sqrt(power(avg(sin(x)), 2) + power(avg(cos(x)), 2)) AS var FROM v GROUP BY 1),
o AS (SELECT vec_id, k, var, sin(x - m) AS s FROM v JOIN m USING (k))
SELECT 'e' || p.k AS a, 'e' || q.k AS b, round(CASE WHEN p.k = q.k THEN any_value(p.var) ELSE sum(p.s * q.s) / sqrt(sum(p.s * p.s) * sum(q.s * q.s)) * sqrt(any_value(p.var) * any_value(q.var)) END, 6) + 0.0 AS covariance
FROM o p JOIN o q ON p.vec_id = q.vec_id AND p.k <= q.k GROUP BY p.k, q.k""")
def circular_matrix(spark, d):
    """Circular variances and covariances of angles."""
    return stats.circular_covariance(vectors(spark, d), NAMES).select("a", "b", r("covariance").alias("covariance"))


@query(f"""WITH {CELLS}, z AS (SELECT label, k, x, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM v WINDOW w AS (PARTITION BY k)),
c AS (SELECT label, k, count(*) AS n, avg((x - m) / s) AS score, avg(x) AS own, any_value(m) AS m, any_value(s) AS s FROM z GROUP BY 1, 2),
i AS (SELECT k, sum(n * power(own - m, 2)) / sum(n) / power(any_value(s), 2) AS importance FROM c GROUP BY 1)
SELECT label, 'e' || k AS feature, round(score, 6) + 0.0 AS score, round(importance, 6) + 0.0 AS importance, round(score * importance, 8) + 0.0 AS weighted FROM c JOIN i USING (k)""")
def class_profiles(spark, d):
    """Mean standard score of all features by class, alone and times the feature's importance."""
    p = stats.class_profiles(vectors(spark, d), "label", NAMES)
    return p.select("label", "feature", r("score").alias("score"), r("importance").alias("importance"), r("weighted", 8).alias("weighted"))


@query("SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 6) + 0.0 AS share FROM (SELECT o_orderstatus AS truth, o_orderpriority AS predicted, count(*) AS n FROM orders GROUP BY ALL)")
def confusion_shares(spark, d):
    m = stats.confusion_shares(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return m.select(F.col("o_orderstatus").alias("truth"), F.col("o_orderpriority").alias("predicted"), "n", r("share").alias("share"))


def _drawn(where: str, share: int, salt: str) -> str:
    rows = f"SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS size FROM embeddings WHERE {where}"
    draws = f"SELECT i AS draw, CAST('0x' || substr(md5('{salt}' || i), 1, 12) AS BIGINT) AS h FROM range((SELECT count(*) // {share} FROM embeddings)) t(i)"
    return f"SELECT draw, vec_id FROM (SELECT draw, h % (SELECT count(*) FROM embeddings WHERE {where}) AS pos FROM ({draws})) JOIN ({rows}) USING (pos)"


@query(f"SELECT draw, vec_id, 'member' AS kind FROM ({_drawn('label < 5', 5, 'm')}) UNION ALL SELECT draw, vec_id, 'contaminant' FROM ({_drawn('label >= 5', 50, 'c')})")
def contaminated_sample(spark, d):
    """A training set of a fifth as many rows as there are, drawn with replacement from some classes, and a tenth as many contaminants from the others."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    n = v.count()
    own, other = stats.drawn(v.where("label < 5"), n // 5, "vec_id", "m"), stats.drawn(v.where("label >= 5"), n // 50, "vec_id", "c")
    return own.select("draw", "vec_id", F.lit("member").alias("kind")).unionByName(other.select("draw", "vec_id", F.lit("contaminant").alias("kind")))


@query(f"""WITH {SKY}, h AS (SELECT b, count(sourceid)::DOUBLE AS n FROM range(20) t(b) LEFT JOIN sky ON mag BETWEEN -3 AND 3 AND least(19, floor((mag + 3) / 0.3::DOUBLE)) = b GROUP BY b),
p AS (SELECT sourceid, mag, least(19, greatest(0, (mag + 3) / 0.3::DOUBLE - 0.5)) AS x FROM sky),
q AS (SELECT sourceid, a.n + (c.n - a.n) * (x - a.b) AS density FROM p JOIN h a ON a.b = least(18, floor(x)) JOIN h c ON c.b = a.b + 1)
SELECT sourceid FROM q ORDER BY ln(((sourceid * 7919) % 100003 + 1) / 100004.0::DOUBLE) * greatest(1, density) DESC, sourceid LIMIT 100""")
def density_sample(spark, d):
    """A hundred sources without replacement, rare magnitudes as likely as common ones: weights are the inverse of the magnitudes' own histogram."""
    u = ((F.col("sourceid") * 7919) % 100003 + 1) / F.lit(100004.0)
    s = stats.density_weight(sky(spark, d).select("sourceid", "mag"), "mag", -3.0, 3.0, 20)
    return s.withColumn("k", F.log(u) / F.col("weight")).orderBy(F.desc("k"), "sourceid").limit(100).select("sourceid")


@query("""SELECT l_returnflag AS kind, count(*) AS n, count(*) FILTER (abs(l_extendedprice / (l_quantity * (900 + l_partkey % 1000)) - 1) > 0.1) AS beyond FROM lineitem GROUP BY 1""")
def tolerance_match(spark, d):
    """How many values differ from what was expected by more than a tenth of it."""
    rows = table(spark, d, "lineitem").withColumn("expected", F.col("l_quantity") * (900 + F.col("l_partkey") % 1000))
    beyond = expr.beyond_tolerance("l_extendedprice", "expected", 0.1)
    return rows.groupBy(F.col("l_returnflag").alias("kind")).agg(count().alias("n"), F.count_if(beyond).alias("beyond"))


@query(f"WITH {SKY} SELECT sourceid, round(15 + mag, 6) + 0.0 AS j, round(15 + mag - (14 + mag / 2) - 0.4, 6) + 0.0 AS ejk, round(14 + mag / 2, 6) + 0.0 AS ks FROM sky")
def colour_excess(spark, d):
    """Colour excess from the colour and the intrinsic colour, put between the two magnitudes."""
    s = sky(spark, d).select("sourceid", (15 + F.col("mag")).alias("j"), (14 + F.col("mag") / 2).alias("ks"))
    out = expr.inserted(s, "ejk", F.col("j") - F.col("ks") - 0.4, 2)
    return out.select("sourceid", *[r(c).alias(c) for c in out.columns[1:]])


@query("SELECT c_custkey AS sourceid, c_name AS name_cat, c_nationkey AS nationkey_cat, c_mktsegment AS mktsegment_cat, round(c_acctbal, 2) + 0.0 AS acctbal_cat FROM customer")
def tidy_columns(spark, d):
    """Names by rule: lower case, a prefix taken off, a suffix put on, some columns dropped by a part of their name."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("SourceID"), "c_name", "c_nationkey", "c_mktsegment", r("c_acctbal", 2).alias("C_ACCTBAL"), F.lit(0.0).alias("c_acctbal_err"))
    return expr.tidied(c, without="_err", pattern="^c_", suffix="_cat", keep=("sourceid",))


@query(f"""WITH {DETECTIONS}, m AS (SELECT *, avg(mag) OVER w AS a, stddev_pop(mag) OVER w AS s FROM lc WINDOW w AS (PARTITION BY sourceid))
SELECT sourceid, count(*) AS n, round(avg(mag), 6) + 0.0 AS mean, round(median(mag), 6) + 0.0 AS median, round(avg(CASE WHEN mag > a - s AND mag < a + s THEN 0 ELSE 1 END), 6) + 0.0 AS beyondfrac FROM m GROUP BY 1""")
def bucketed_moments(spark, d):
    """Light curves as a catalogue table in buckets by source, and moments over it without an exchange. The table's name follows the folder."""
    name = f"lc_{zlib.crc32(d.encode()):08x}"
    m = stats.moments(files.save_bucketed(detections(spark, d).select("sourceid", "mag", "emag"), name, "sourceid", 16))
    return m.select("sourceid", "n", r("mean").alias("mean"), r("median").alias("median"), r("beyondfrac").alias("beyondfrac"))


@query("SELECT o_custkey AS sourceid, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1")
def ctas_counts(spark, d):
    """A table created from SQL text over a view of the orders, in buckets by customer."""
    view = f"orders_{zlib.crc32(d.encode()):08x}"
    table(spark, d, "orders").createOrReplaceTempView(view)
    made = files.create_table(spark, f"{view}_t", f"SELECT o_custkey AS sourceid, o_totalprice FROM {view}", "sourceid", 8)
    return made.groupBy("sourceid").agg(count().alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {DETECTIONS} SELECT sourceid, count(*) AS n, round(sum(mag), 4) + 0.0 AS mag FROM lc WHERE sourceid IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 0) GROUP BY 1")
def routed_files(spark, d):
    """Light curves kept in a folder by the remainder of their number; those wanted are read from their folders."""
    path = new_folder(spark)
    route = F.col("sourceid") % 16
    files.write_routed(detections(spark, d).select("sourceid", "mag"), path, route)
    wanted = table(spark, d, "customer").where("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("sourceid"))
    rows = files.read_routed(spark, path, "sourceid long, mag double", wanted, "sourceid", route)
    return rows.groupBy("sourceid").agg(count().alias("n"), r(F.sum("mag"), 4).alias("mag"))
