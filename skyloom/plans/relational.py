"""Scans, joins, set operations, orderings and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import stats
from skyloom.operators.ordering import numbered
from skyloom.plans.registry import Registry, count, r
from skyloom.sources.views import table

query = Registry()


@query("""SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""")
def star_join(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "c_mktsegment").agg(count().alias("n"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT n_name, count(*) AS customers, count(o_orderkey) AS orders, count(*) FILTER (o_orderkey IS NULL) AS without
FROM customer LEFT JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def left_join_missing(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(count().alias("customers"), count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


@query("""SELECT coalesce(a.k, b.k) AS nationkey, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) // 10 AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def full_outer_mismatch(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.expr("count(*) div 10").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(count().alias("suppliers"))
    return a.join(b, "nationkey", "full").where(~F.col("customers").eqNullSafe(F.col("suppliers")))


@query("SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1")
def right_join(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 1")
    return n.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def semi_restrict(spark, d):
    ids = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(ids, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def anti_new_sources(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""WITH p AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
SELECT p_brand, count(*) AS n, round(sum(q), 2) + 0.0 AS quantity FROM p JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 10 AND 20 GROUP BY 1""")
def cte_join(spark, d):
    p = table(spark, d, "lineitem").where("l_discount > 0.05").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return p.join(table(spark, d, "part").where("p_size BETWEEN 10 AND 20"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(count().alias("n"), r(F.sum("q"), 2).alias("quantity"))


@query("""SELECT vec_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY k) AS n FROM (
SELECT vec_id, 'variable' AS origin, 0 AS k FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, 'constant', 1 FROM embeddings WHERE vec_id % 2 = 0)) WHERE n = 1""")
def priority_union_dedup(spark, d):
    e = table(spark, d, "embeddings")
    parts = [e.where("label < 3").select("vec_id", F.lit("variable").alias("origin")), e.where("vec_id % 2 = 0").select("vec_id", F.lit("constant").alias("origin"))]
    return stats.first_by_priority(parts, ["vec_id"])


@query("SELECT user_id, event_type, event_id, round(value, 6) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) = 1")
def dedup_nearest(spark, d):
    best = stats.keep_best(table(spark, d, "events"), ["user_id", "event_type"], [F.col("value").asc(), F.col("event_id").asc()])
    return best.select("user_id", "event_type", "event_id", r("value").alias("value"))


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, count(*) AS n FROM orders GROUP BY 1")
def dedup_keep_last(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), count().alias("n"))


@query("""SELECT c_custkey AS id, c_nationkey AS nationkey, 'a' AS origin FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT s_suppkey, s_nationkey, 'b' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def fallback_union(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nationkey"), F.lit("a").alias("origin"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nationkey"), F.lit("b").alias("origin"))
    return stats.fallback(a, b, ["id"])


@query("""SELECT p_partkey, round(coalesce(CASE WHEN p_size > 25 THEN p_retailprice END, m), 4) + 0.0 AS price FROM part
LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def coalesce_patch(spark, d):
    base = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("price"))
    patch = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("price"))
    return stats.patched(base, patch, ["p_partkey"], ["price"]).select("p_partkey", r("price", 4).alias("price"))


@query("""SELECT x.l_orderkey, x.l_partkey AS part_x, y.l_partkey AS part_y, round(x.l_quantity - y.l_quantity, 4) + 0.0 AS dq FROM lineitem x JOIN lineitem y
ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_returnflag <> y.l_returnflag""")
def version_compare(spark, d):
    x, y = table(spark, d, "lineitem").alias("x"), table(spark, d, "lineitem").alias("y")
    j = x.join(y, (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & (F.col("y.l_linenumber") == F.col("x.l_linenumber") + 1)).where("x.l_returnflag <> y.l_returnflag")
    return j.select("x.l_orderkey", F.col("x.l_partkey").alias("part_x"), F.col("y.l_partkey").alias("part_y"), r(F.col("x.l_quantity") - F.col("y.l_quantity"), 4).alias("dq"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) FILTER (o_totalprice > 100000) / count(*), 6) + 0.0 AS dear FROM orders GROUP BY ALL")
def class_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(count().alias("n"), r(F.avg((F.col("o_totalprice") > 100000).cast("double"))).alias("dear"))


@query("""WITH p AS (SELECT quality AS t, toxic AS g FROM labels), c AS (SELECT DISTINCT t AS class FROM p UNION SELECT DISTINCT g FROM p)
SELECT class, count(*) FILTER (t = class) AS support, round(count(*) FILTER (t = class AND g = class) / nullif(count(*) FILTER (g = class), 0), 6) + 0.0 AS "precision",
round(count(*) FILTER (t = class AND g = class) / nullif(count(*) FILTER (t = class), 0), 6) + 0.0 AS recall FROM p, c GROUP BY class""")
def precision_recall(spark, d):
    m = stats.class_metrics(table(spark, d, "labels"), "quality", "toxic")
    return m.select("class", F.col("support").cast("long").alias("support"), r("precision").alias("precision"), r("recall").alias("recall"))


@query("SELECT quality, count(*) FILTER (toxic = 0) AS t0, count(*) FILTER (toxic = 1) AS t1, round(count(*) FILTER (toxic = 1) / count(*), 6) + 0.0 AS share1 FROM labels GROUP BY quality")
def confusion_matrix(spark, d):
    p = table(spark, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).count()
    t0, t1 = F.coalesce("0", F.lit(0)), F.coalesce("1", F.lit(0))
    return p.select("quality", t0.cast("long").alias("t0"), t1.cast("long").alias("t1"), r(t1 / (t0 + t1)).alias("share1"))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicated_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(count().alias("n"), F.min("l_linenumber").alias("first_line")).where("n > 1")


@query("SELECT c_nationkey AS nationkey, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customer only' FROM customer EXCEPT SELECT s_nationkey, 'customer only' FROM supplier)")
def set_operations(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(c.subtract(s).withColumn("kind", F.lit("customer only")))


@query("""SELECT 'part' AS origin, p_partkey AS id, p_retailprice AS price, NULL AS balance FROM part WHERE p_size = 1
UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier""")
def union_by_name(spark, d):
    a = table(spark, d, "part").where("p_size = 1").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH up AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS xid, user_id FROM events WHERE event_type = 'purchase')
SELECT xid, c_custkey, c_name FROM up JOIN customer ON user_id = c_custkey""")
def upload_join(spark, d):
    """Rows of an outside list keep their position through a join."""
    up = numbered(table(spark, d, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("c_custkey")), "event_id", name="xid")
    return up.join(table(spark, d, "customer"), "c_custkey").select("xid", "c_custkey", "c_name")


@query("SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_k(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", r("o_totalprice", 2).alias("price"))


@query("SELECT event_id, user_id FROM events ORDER BY (event_id * 2654435761) % 4294967296, event_id LIMIT 500")
def hash_ordered_sample(spark, d):
    return table(spark, d, "events").orderBy((F.col("event_id") * 2654435761) % 4294967296, "event_id").limit(500).select("event_id", "user_id")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, ln(((o_orderkey * 7919) % 100003 + 1) / 100004.0::DOUBLE) / (1 / greatest(1.0::DOUBLE, o_totalprice / 1000)) AS k FROM orders)
ORDER BY k DESC, o_orderkey LIMIT 300""")
def weighted_sample(spark, d):
    """Without replacement, by exponential keys; weights are the inverse of a density with a floor."""
    u = ((F.col("o_orderkey") * 7919) % 100003 + 1) / F.lit(100004.0)
    weight = 1 / F.greatest(F.lit(1.0), F.col("o_totalprice") / 1000)
    return table(spark, d, "orders").withColumn("k", F.log(u) / weight).orderBy(F.desc("k"), "o_orderkey").limit(300).select("o_orderkey")


@query("SELECT fold, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS fold FROM embeddings) GROUP BY fold")
def fold_column(spark, d):
    fold = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("long") % 10
    return table(spark, d, "embeddings").select("vec_id", fold.alias("fold")).groupBy("fold").agg(count().alias("n"), F.min("vec_id").alias("first"))


@query("SELECT sourceid, event_id, k FROM (SELECT user_id AS sourceid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k > n - 3")
def tail_slice(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("sourceid")
    e = table(spark, d, "events").select(F.col("user_id").alias("sourceid"), "event_id", "ts")
    e = e.withColumns({"k": F.row_number().over(w.orderBy("ts", "event_id")).cast("long"), "n": F.count("*").over(w)})
    return e.where("k > n - 3").select("sourceid", "event_id", "k")


@query("SELECT chunk, count(*) AS n, min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM (SELECT s_suppkey, ntile(8) OVER (ORDER BY (s_suppkey * 31) % 1009, s_suppkey) AS chunk FROM supplier) GROUP BY chunk")
def shuffled_chunks(spark, d):
    """Eight chunks of nearly equal size in a shuffled order; the first ones take what is over."""
    s = table(spark, d, "supplier").select("s_suppkey")
    size, over = divmod(s.count(), 8)
    at = numbered(s.withColumn("key", (F.col("s_suppkey") * 31) % 1009), "key", "s_suppkey", name="at")
    late = F.when(F.lit(size > 0), F.floor((F.col("at") - over * (size + 1)) / max(1, size)) + over)
    c = at.select("s_suppkey", (F.when(F.col("at") < over * (size + 1), F.floor(F.col("at") / (size + 1))).otherwise(late) + 1).cast("long").alias("chunk"))
    return c.groupBy("chunk").agg(count().alias("n"), F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi"))


@query("SELECT c_mktsegment, n_regionkey, count(*) AS n, grouping(c_mktsegment) * 2 + grouping(n_regionkey) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_regionkey)")
def rollup_counts(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("c_mktsegment", "n_regionkey").agg(count().alias("n"), F.grouping_id().cast("long").alias("level"))
