"""Positions, grids, cross-matches and pixels."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.functions import sky as S
from skyloom.operators import joins
from skyloom.plans.registry import Registry, count, r
from skyloom.sources.views import DETECTIONS, SKY, sky

query = Registry()

SEP = "degrees(2 * asin(sqrt(least(1.0::DOUBLE, power(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * power(sin((radians({c}) - radians({a})) / 2), 2)))))"


def sep(a, b, c, d):
    return SEP.format(a=a, b=b, c=c, d=d)


@query(f"WITH {SKY} SELECT sourceid, round(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM sky")
def wrap_longitude(spark, d):
    return sky(spark, d).select("sourceid", r(expr.signed_longitude("lon")).alias("lon"), r("lat").alias("lat"))


@query(f"""WITH {SKY}, n AS (SELECT floor(lon / 10)::BIGINT * 18 + floor((least(greatest(lat, -89.999999), 89.999999) + 90) / 10)::BIGINT AS cell, count(*) AS n FROM sky GROUP BY 1)
SELECT (i * 18 + j)::BIGINT AS cell, (5 + 10 * i)::DOUBLE AS l, (-85 + 10 * j)::DOUBLE AS b, coalesce(n, 0)::BIGINT AS n FROM range(36) x(i), range(18) y(j) LEFT JOIN n ON n.cell = i * 18 + j""")
def make_grid(spark, d):
    """Centres of regular boxes with the number of sources in each, empty ones too; numbers follow longitude, then latitude."""
    g = spark.range(36).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(17))))
    g = g.select((F.col("i") * 18 + F.col("j")).cast("long").alias("cell"), r(5 + 10 * F.col("i"), 4).alias("l"), r(-85 + 10 * F.col("j"), 4).alias("b"))
    s = sky(spark, d).withColumn("lat", expr.clamp("lat", -90, 90, 1e-6))
    n = joins.grid_cell(s, "lon", "lat", 0, -90, 10, 10, 36, 18).groupBy("cell").agg(count().alias("n"))
    return g.join(n, "cell", "left").select("cell", "l", "b", F.coalesce("n", F.lit(0)).alias("n"))


#: Two footprints that overlap: lon from, to, lat from, to, sizes.
FOOTPRINTS = [(-60.0, 62.0, -60.0, 31.0, 10.0, 10.0), (-130.0, 11.0, -12.0, 13.0, 20.0, 5.0)]


@query(f"""WITH {SKY}, g AS (SELECT j * 12 + i AS cell, 0 AS footprint, -55 + 10 * i AS l, -55 + 10 * j AS b, 10 AS dl, 10 AS db FROM range(12) x(i), range(9) y(j)
UNION ALL SELECT 108 + j * 7 + i, 1, -120 + 20 * i, -9.5 + 5 * j, 20, 5 FROM range(7) x(i), range(4) y(j))
SELECT cell::BIGINT AS cell, footprint::INTEGER AS footprint, l::DOUBLE AS l, b::DOUBLE AS b, count(sourceid) AS n FROM g LEFT JOIN sky ON fmod(lon - (l - dl / 2::DOUBLE) + 720, 360) < dl AND lat >= b - db / 2::DOUBLE AND lat < b + db / 2::DOUBLE GROUP BY ALL""")
def footprint_counts(spark, d):
    """Boxes of two footprints, numbered on, with the number of sources in each; sources in both count twice."""
    n = joins.in_footprints(sky(spark, d), "lon", "lat", FOOTPRINTS).groupBy("cell").agg(count().alias("n"))
    return joins.footprint_grid(spark, FOOTPRINTS).join(n, "cell", "left").select("cell", "footprint", r("l").alias("l"), r("b").alias("b"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {SKY} SELECT floor(lon / 10)::BIGINT * 18 + floor((least(greatest(lat, -89.999999), 89.999999) + 90) / 10)::BIGINT AS cell, count(*) AS n, round(avg(mag), 6) + 0.0 AS mag FROM sky GROUP BY 1")
def assign_cell(spark, d):
    s = sky(spark, d).withColumn("lat", expr.clamp("lat", -90, 90, 1e-6))
    c = joins.grid_cell(s, "lon", "lat", 0, -90, 10, 10, 36, 18)
    return c.groupBy("cell").agg(count().alias("n"), r(F.avg("mag")).alias("mag"))


@query(f"WITH {SKY} SELECT sourceid, round({sep('lon', 'lat', '120', '20')}, 6) + 0.0 AS distance FROM sky WHERE {sep('lon', 'lat', '120', '20')} < 30")
def cone_search(spark, d):
    s = sky(spark, d).where(S.in_cone("lon", "lat", 120, 20, 30))
    return s.select("sourceid", r(S.separation("lon", "lat", F.lit(120.0), F.lit(20.0))).alias("distance"))


@query(f"WITH {SKY} SELECT sourceid FROM sky WHERE (lon > 330 OR lon < 40) AND lat > -30 AND lat < 30")
def box_wrap(spark, d):
    return sky(spark, d).where(S.in_box("lon", "lat", 330, 40, -30, 30)).select("sourceid")


MATCH = f"""{SKY}, m AS (SELECT a.sourceid AS left_id, b.sourceid AS right_id, {sep('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS sep FROM sky a, sky b WHERE a.sourceid % 2 = 0 AND b.sourceid % 2 = 1),
n AS (SELECT * FROM m WHERE sep < 3 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY sep, right_id) = 1)"""


def halves(spark, d):
    s = sky(spark, d).select(F.col("sourceid").alias("id"), "lon", "lat")
    return s.where("id % 2 = 0"), s.where("id % 2 = 1")


@query(f"WITH {MATCH} SELECT left_id, right_id, round(sep, 6) + 0.0 AS sep FROM n")
def xmatch_nearest(spark, d):
    a, b = halves(spark, d)
    return joins.cross_match(a, b, 3.0).select("left_id", "right_id", r("sep").alias("sep"))


@query(f"WITH {MATCH} SELECT sourceid, right_id, n.left_id IS NOT NULL AS matched FROM sky LEFT JOIN n ON sourceid = left_id WHERE sourceid % 2 = 0")
def matched_unmatched(spark, d):
    a, b = halves(spark, d)
    return a.join(joins.cross_match(a, b, 3.0), F.col("id") == F.col("left_id"), "left").select(F.col("id").alias("sourceid"), "right_id", F.col("left_id").isNotNull().alias("matched"))


@query(f"""WITH {SKY}, p AS (SELECT sourceid, lon + (sourceid % 100 - 50) * 36000 * 2 / 3.6e6 / cos(radians(lat)) AS lon, lat + (sourceid % 70 - 35) * 36000 * 2 / 3.6e6 AS lat FROM sky),
m AS (SELECT a.sourceid AS left_id, b.sourceid AS right_id, {sep('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS sep FROM p a, p b WHERE a.sourceid % 2 = 0 AND b.sourceid % 2 = 1)
SELECT left_id, right_id, round(sep, 6) + 0.0 AS sep FROM m WHERE sep < 2 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY sep, right_id) = 1""")
def xmatch_pm(spark, d):
    """Cross-match of positions moved by their proper motion to one epoch, over the poles too."""
    s = sky(spark, d).withColumns({"pl": ((F.col("sourceid") % 100 - 50) * 36000).cast("double"), "pb": ((F.col("sourceid") % 70 - 35) * 36000).cast("double")})
    lon, lat = S.wrapped(*S.moved("lon", "lat", "pl", "pb", 2.0))
    s = s.select(F.col("sourceid").alias("id"), lon.alias("lon"), lat.alias("lat"))
    return joins.cross_match(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 2.0).select("left_id", "right_id", r("sep").alias("sep"))


ROT = S.TO_GALACTIC


@query(f"""WITH {SKY}, v AS (SELECT sourceid, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM sky),
g AS (SELECT sourceid, {', '.join('+ '.join(f'({m}::DOUBLE) * {c} ' for m, c in zip(row, 'xyz', strict=True)) + 'AS ' + n for row, n in zip(ROT, ('gx', 'gy', 'gz'), strict=True))} FROM v)
SELECT sourceid, round(fmod(degrees(atan2(gy, gx)) + 360, 360), 5) + 0.0 AS l, round(degrees(asin(gz)), 5) + 0.0 AS b FROM g""")
def galactic_coords(spark, d):
    s = sky(spark, d)
    lon, lat = S.galactic("lon", "lat")
    return s.select("sourceid", r(lon, 5).alias("l"), r(lat, 5).alias("b"))


@query("""WITH i AS (SELECT k AS idx, k * 37 + (k * k) % 11 AS start, (k % 7) / 10.0::DOUBLE AS ext, (k % 3) / 100.0::DOUBLE AS spread, 5 + k % 4 AS level FROM range(40) t(k)), p AS (SELECT l_orderkey, l_linenumber, l_partkey % 1600 AS pix FROM lineitem)
SELECT l_orderkey, l_linenumber, pix, idx, round(ext, 4) + 0.0 AS ext, round(spread, 4) + 0.0 AS spread, round(sqrt(4 * pi() / 12) / power(2, level), 8) + 0.0 AS resolution FROM p ASOF JOIN i ON pix >= start""")
def moc_lookup(spark, d):
    """Pixel to the last index row that starts at or before it: its value, spread and resolution (the side of a pixel of its level)."""
    from skyloom.sources.views import table

    k = F.col("id")
    index = spark.range(40).select(k.alias("idx"), (k * 37 + (k * k) % 11).alias("start"), ((k % 7) / 10).alias("ext"), ((k % 3) / 100).alias("spread"), (5 + k % 4).alias("level"))
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1600).alias("pix"))
    m = joins.predecessor(p, index, "pix", "start")
    side = (4 * math.pi / 12) ** 0.5 / F.pow(F.lit(2.0), F.col("level"))
    return m.select("l_orderkey", "l_linenumber", "pix", "idx", r("ext", 4).alias("ext"), r("spread", 4).alias("spread"), r(side, 8).alias("resolution"))


@query(f"""WITH {SKY}, m AS (SELECT a.sourceid AS left_id, b.sourceid AS right_id, {sep('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS sep FROM sky a, sky b WHERE a.sourceid % 2 = 0 AND b.sourceid % 2 = 1)
SELECT left_id, right_id, round(sep, 6) + 0.0 AS sep, true AS forward FROM m QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY sep, right_id) = 1
UNION ALL SELECT left_id, right_id, round(sep, 6) + 0.0, false FROM m QUALIFY row_number() OVER (PARTITION BY right_id ORDER BY sep, left_id) = 1""")
def xmatch_both_ways(spark, d):
    """Nearest neighbours at any distance, in both directions."""
    return joins.both_ways(*halves(spark, d)).select("left_id", "right_id", r("sep").alias("sep"), "forward")


def _pixel(level: int) -> str:
    """Nested and ring pixels of a level in SQL: tables pixels(sourceid, nested, ring)."""
    side = 1 << level
    bits = " + ".join(f"(((({c} >> {k}) & 1)) << {2 * k + odd})" for k in range(level) for odd, c in enumerate("xy"))
    return f"""z AS (SELECT sourceid, sin(radians(lat)) AS z, lon / 90 AS turn, least(3, floor(lon / 90))::BIGINT AS q FROM sky),
l AS (SELECT *, abs(z) <= 2 / 3::DOUBLE AS belt,
  CASE WHEN abs(z) <= 2 / 3::DOUBLE THEN floor({side} * (0.5 + turn - 0.75 * z))::BIGINT ELSE least({side - 1}, floor((turn - q) * {side} * sqrt(3 * (1 - abs(z)))))::BIGINT END AS up,
  CASE WHEN abs(z) <= 2 / 3::DOUBLE THEN floor({side} * (0.5 + turn + 0.75 * z))::BIGINT ELSE least({side - 1}, floor((1 - turn + q) * {side} * sqrt(3 * (1 - abs(z)))))::BIGINT END AS down FROM z),
xy AS (SELECT *, CASE WHEN NOT belt THEN q + CASE WHEN z >= 0 THEN 0 ELSE 8 END WHEN up // {side} = down // {side} THEN (up // {side}) % 4 + 4 WHEN up // {side} < down // {side} THEN (up // {side}) % 4 ELSE (down // {side}) % 4 + 8 END AS face,
  CASE WHEN belt THEN down % {side} WHEN z >= 0 THEN {side - 1} - down ELSE up END AS x, CASE WHEN belt THEN {side - 1} - up % {side} WHEN z >= 0 THEN {side - 1} - up ELSE down END AS y,
  CASE WHEN belt THEN {side + 1} + up - down ELSE up + down + 1 END AS row_ FROM l),
pixels AS (SELECT sourceid, (face * {side * side} + {bits})::BIGINT AS nested, (CASE WHEN belt THEN {2 * side * (side - 1)} + (row_ - 1) * {4 * side} + ((up + down - {side} + 2 - row_ % 2) // 2 + {4 * side}) % {4 * side}
  WHEN z >= 0 THEN 2 * row_ * (row_ - 1) + floor(turn * row_)::BIGINT ELSE {12 * side * side} - 2 * row_ * (row_ + 1) + floor(turn * row_)::BIGINT END)::BIGINT AS ring FROM xy)"""


@query(f"WITH {SKY}, {_pixel(3)} SELECT nested AS pixel, nested // 16 AS parent, count(*) AS n FROM pixels GROUP BY ALL")
def pixel_counts(spark, d):
    """Sources per nested equal-area pixel of level 3, and the pixel of level 1 that holds it."""
    p = S.with_pixel(sky(spark, d), "pixel", "lon", "lat", 3)
    return p.groupBy("pixel", S.at_level("pixel", 3, 1).alias("parent")).agg(count().alias("n"))


@query(f"WITH {SKY}, {_pixel(4)} SELECT sourceid, ring FROM pixels WHERE ring BETWEEN 480 AND 1500")
def ring_pixels(spark, d):
    """Sources of a run of ring pixels, that is, of a belt of the sky."""
    return S.with_pixel(sky(spark, d), "ring", "lon", "lat", 4, nested=False).where("ring BETWEEN 480 AND 1500").select("sourceid", "ring")


_A, _D = "radians(lon)", "radians(lat)"
MOTION = f"""pm AS (SELECT sourceid, lon, lat, (sourceid % 101 - 50) / 10.0::DOUBLE AS pa, (sourceid % 71 - 35) / 10.0::DOUBLE AS pd FROM sky),
v AS (SELECT sourceid, cos({_D}) * cos({_A}) AS x, cos({_D}) * sin({_A}) AS y, sin({_D}) AS z, -pa * sin({_A}) - pd * sin({_D}) * cos({_A}) AS vx, pa * cos({_A}) - pd * sin({_D}) * sin({_A}) AS vy, pd * cos({_D}) AS vz FROM pm),
g AS (SELECT sourceid, {', '.join(' + '.join(f'({m}::DOUBLE) * {c}' for m, c in zip(row, cols, strict=True)) + ' AS ' + n for cols, names in (('xyz', ('gx', 'gy', 'gz')), (('vx', 'vy', 'vz'), ('hx', 'hy', 'hz'))) for row, n in zip(ROT, names, strict=True))} FROM v),
motion AS (SELECT sourceid, cos(atan2(gy, gx)) * hy - sin(atan2(gy, gx)) * hx AS pm_l, cos(asin(gz)) * hz - sin(asin(gz)) * (cos(atan2(gy, gx)) * hx + sin(atan2(gy, gx)) * hy) AS pm_b FROM g)"""


def motions(spark, d):
    s = sky(spark, d).withColumns({"pa": (F.col("sourceid") % 101 - 50) / F.lit(10.0), "pd": (F.col("sourceid") % 71 - 35) / F.lit(10.0)})
    along, across = S.galactic_motion("lon", "lat", "pa", "pd")
    return s.select("sourceid", along.alias("pm_l"), across.alias("pm_b"))


@query(f"WITH {SKY}, {MOTION} SELECT sourceid, round(pm_l, 6) + 0.0 AS pm_l, round(pm_b, 6) + 0.0 AS pm_b FROM motion")
def galactic_motion(spark, d):
    return motions(spark, d).select("sourceid", r("pm_l").alias("pm_l"), r("pm_b").alias("pm_b"))


@query(f"WITH {SKY}, {MOTION} SELECT sourceid FROM motion WHERE pm_l > -2 AND pm_l < 3 AND pm_b > -1.5 AND pm_b < 1")
def pm_box(spark, d):
    """Sources whose proper motion lies in a box."""
    return motions(spark, d).where("pm_l > -2 AND pm_l < 3 AND pm_b > -1.5 AND pm_b < 1").select("sourceid")


@query(f"""WITH {SKY}, p AS (SELECT sourceid, lon, lat, 12 + 3 * abs(mag) AS k, 0.3 + abs(mag) AS jk, 0.2 + 0.01 * (sourceid % 90) AS period, label FROM sky),
q AS (SELECT *, power(10.0::DOUBLE, 0.2 * (k - 0.5 * jk + 2.5 * log10(period) + 1.1) - 2) AS d FROM p)
SELECT sourceid, round(d, 6) + 0.0 AS distance, round(d * cos(radians(lon)) * cos(radians(lat)), 6) + 0.0 AS x, round(d * sin(radians(lon)) * cos(radians(lat)), 6) + 0.0 AS y FROM q""")
def pl_distance(spark, d):
    """Distances of a period-luminosity-colour relation and their map on the plane."""
    s = sky(spark, d).withColumns({"k": 12 + 3 * F.abs("mag"), "jk": 0.3 + F.abs("mag"), "period": 0.2 + 0.01 * (F.col("sourceid") % 90)})
    s = s.withColumn("distance", expr.relation_distance("k", "jk", "period", 0.5, 2.5, 1.1))
    return s.select("sourceid", r("distance").alias("distance"), *[r(c).alias(n) for c, n in zip(expr.on_plane("distance", "lon", "lat"), ("x", "y"), strict=True)])


_RELATED = "p AS (SELECT sourceid, 12 + 3 * abs(mag) AS k, 12.3 + 4 * abs(mag) AS j, log10(0.2 + 0.01 * (sourceid % 90)) AS lp, -1.5 + mag AS feh, CASE label % 4 WHEN 0 THEN 'RRab' WHEN 1 THEN 'RRcd' WHEN 2 THEN 'EW' ELSE 'Ell' END AS kind FROM sky)"
_FREE = "power(10.0::DOUBLE, 0.2 * (k - 0.428 * (j - k) + {slope} * lp + {zero}) - 2)"


@query(f"""WITH {SKY}, {_RELATED} SELECT sourceid, kind, round(CASE kind WHEN 'RRab' THEN {_FREE.format(slope='(2.84 - 0.428 * (2.5 - 2.84))', zero='18.477 - (17.36 - 0.428 * (17.699 - 17.36))')} WHEN 'RRcd' THEN {_FREE.format(slope='(2.98 - 0.428 * (2.53 - 2.98))', zero='18.477 - (16.86 - 0.428 * (17.241 - 16.86))')}
WHEN 'EW' THEN {_FREE.format(slope='(5.94 - 0.428 * (6.84 - 5.94))', zero='(0 - 0.428 * 0.039)')} END, 5) + 0.0 AS distance,
round(CASE kind WHEN 'RRab' THEN {_FREE.format(slope='(2.80 - 0.428 * (2.45 - 2.80))', zero='18.477 - (17.547 - 0.428 * (17.888 - 17.547)) - (0.114 - 0.428 * (0.121 - 0.114)) * feh')}
WHEN 'RRcd' THEN {_FREE.format(slope='(2.99 - 0.428 * (2.53 - 2.99))', zero='18.477 - (16.85 - 0.428 * (17.225 - 16.85)) - (0.011 - 0.428 * (-0.01 - 0.011)) * feh')} END, 5) + 0.0 AS metal_distance FROM p""")
def class_distances(spark, d):
    """Distances by the period-luminosity relation of each source's class, without and with a metallicity term."""
    kind = F.when(F.col("label") % 4 == 0, "RRab").when(F.col("label") % 4 == 1, "RRcd").when(F.col("label") % 4 == 2, "EW").otherwise("Ell")
    s = sky(spark, d).withColumns({"k": 12 + 3 * F.abs("mag"), "j": 12.3 + 4 * F.abs("mag"), "period": 0.2 + 0.01 * (F.col("sourceid") % 90), "feh": -1.5 + F.col("mag"), "kind": kind})
    rich = expr.class_distance("kind", "j", "k", "period", expr.METAL_RELATIONS, metal="feh")
    return s.select("sourceid", "kind", r(expr.class_distance("kind", "j", "k", "period"), 5).alias("distance"), r(rich, 5).alias("metal_distance"))


@query(f"""WITH {SKY}, p AS (SELECT sourceid, 0.1 + 5 * abs(mag) AS period, CASE label % 4 WHEN 0 THEN 'EA/EB' WHEN 1 THEN 'EW' WHEN 2 THEN 'Ell' ELSE 'RRab' END AS kind,
abs(sin(sourceid)) AS a1, abs(cos(sourceid)) AS a2, abs(sin(3.0::DOUBLE * sourceid)) AS a3, abs(cos(5.0::DOUBLE * sourceid)) AS a4 FROM sky),
q AS (SELECT *, CASE WHEN a1 >= greatest(a2, a3, a4) THEN 1 WHEN a2 >= greatest(a3, a4) THEN 2 WHEN a3 >= a4 THEN 3 ELSE 4 END AS best FROM p)
SELECT sourceid, kind, round(CASE WHEN kind IN ('EA/EB', 'Ell') THEN CASE WHEN a1 > a2 THEN 2 * period ELSE period END WHEN kind = 'EW' THEN 2 * period / best ELSE period / best END, 6) + 0.0 AS fixed FROM q""")
def period_fix(spark, d):
    s = sky(spark, d)
    kind = F.when(F.col("label") % 4 == 0, "EA/EB").when(F.col("label") % 4 == 1, "EW").when(F.col("label") % 4 == 2, "Ell").otherwise("RRab")
    i = F.col("sourceid").cast("double")
    s = s.select("sourceid", (0.1 + 5 * F.abs("mag")).alias("period"), kind.alias("kind"), F.abs(F.sin(i)).alias("a1"), F.abs(F.cos(i)).alias("a2"), F.abs(F.sin(3 * i)).alias("a3"), F.abs(F.cos(5 * i)).alias("a4"))
    return s.select("sourceid", "kind", r(expr.corrected_period("period", "kind", ["a1", "a2", "a3", "a4"])).alias("fixed"))


@query("""WITH p AS (SELECT event_id, 0.1 + value / 40 AS period FROM events), k AS (SELECT event_id, period, bool_or(abs(1 / period - (h / 0.99726957::DOUBLE + s / 365.25::DOUBLE)) < 0.01) AS near FROM p, range(2, 10) a(h), range(-1, 2) b(s) GROUP BY ALL)
SELECT event_id, round(period, 6) + 0.0 AS period FROM k WHERE NOT near""")
def alias_cut(spark, d):
    from skyloom.sources.views import table

    p = table(spark, d, "events").select("event_id", (0.1 + F.col("value") / 40).alias("period"))
    return p.where(expr.not_alias("period", 0.01)).select("event_id", r("period").alias("period"))


@query("""SELECT event_id, round(year(ts) + date_diff('second', make_timestamp(year(ts), 1, 1, 0, 0, 0), date_trunc('second', ts)) / date_diff('second', make_timestamp(year(ts), 1, 1, 0, 0, 0), make_timestamp(year(ts) + 1, 1, 1, 0, 0, 0)), 8) + 0.0 AS year FROM events""")
def decimal_year(spark, d):
    from skyloom.sources.views import table

    return table(spark, d, "events").select("event_id", r(expr.decimal_year("ts"), 8).alias("year"))


@query(f"""WITH {DETECTIONS}, {SKY}, m AS (SELECT event_id, sourceid, t, lon, lat, min(t) OVER (PARTITION BY sourceid) + 60310 - 51544.5 AS n FROM lc JOIN sky USING (sourceid)),
g AS (SELECT *, radians(357.528 + 0.9856003 * n) AS g, radians(280.460 + 0.9856474 * n + 1.915 * sin(radians(357.528 + 0.9856003 * n)) + 0.020 * sin(2 * radians(357.528 + 0.9856003 * n))) AS sun FROM m)
SELECT event_id, sourceid, round(t + 2460310.5 - (1.00014 - 0.01671 * cos(g) - 0.00014 * cos(2 * g)) * (cos(radians(lat)) * cos(radians(lon)) * cos(sun)
  + (cos(radians(lat)) * sin(radians(lon)) * cos(radians(23.439)) + sin(radians(lat)) * sin(radians(23.439))) * sin(sun)) * 499.004782 / 86400, 6) + 0.0 AS hjd FROM g""")
def heliocentric(spark, d):
    """Times at the Sun: each source's first epoch gives one shift for all its detections."""
    from skyloom.sources.views import detections

    lc = detections(spark, d).join(sky(spark, d).select("sourceid", "lon", "lat"), "sourceid")
    first = F.min("t").over(Window.partitionBy("sourceid")) + 60310.0
    return lc.select("event_id", "sourceid", r(F.col("t") + 2460310.5 + S.light_travel(F.col("lon"), F.col("lat"), first)).alias("hjd"))


@query(f"WITH {SKY} SELECT CASE WHEN abs(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END) < 10 THEN 10.0::DOUBLE ELSE 4.5::DOUBLE END AS height, count(*) AS n, round(sum(1 / CASE WHEN abs(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END) < 10 THEN 10.0::DOUBLE ELSE 4.5::DOUBLE END), 4) + 0.0 AS density FROM sky GROUP BY 1")
def strip_density(spark, d):
    """Sources weighted by the height of the surveyed strip at their longitude."""
    s = sky(spark, d).withColumn("height", expr.strip_weight("lon", 10, 10.0, 4.5))
    return s.groupBy("height").agg(count().alias("n"), r(F.sum(1 / F.col("height")), 4).alias("density"))
