"""Joins by nearness on the sphere, in time and by ranges; each has an equality key, so none compares all pairs."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.sky import moved, separation, wrapped
from skyloom.operators.storage import durable


def cross_match(left: DataFrame, right: DataFrame, radius: float, left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """left_id, right_id, sep of each left row's nearest right row within ``radius`` degrees; ties go to the smaller right id.

    Both sides have id, lon, lat. The sphere is cut into bands of latitude at least ``radius`` high and cells of longitude that
    hold it at the band's edge nearest a pole; right rows are copied to neighbouring bands and cells (nine at most). The height
    follows the radius, so a cell of a crowded field holds what lies within a few radii.
    """
    bands = int(180 / max(radius, 1e-6))
    height = 180 / bands

    def cells(band):
        """Number of longitude cells of a band: one whose edge lies within a radius of a pole."""
        edge = F.least(F.lit(90.0), F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90)) + radius)
        return F.when(edge >= 89.9, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / height)).cast("int")).cast("int")

    band = lambda lat: F.least(F.floor((F.col(lat) + 90) / height), F.lit(bands - 1)).cast("int")
    a = left.select(F.col("id").alias(left_id), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")).withColumn("band", band("lat1"))
    a = a.withColumn("cell", F.least(F.floor(F.col("lon1") / 360 * cells(F.col("band"))), cells(F.col("band")) - 1).cast("int"))
    b = right.select(F.col("id").alias(right_id), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    b = b.withColumn("band", F.explode(F.array(*[band("lat2") + k for k in (-1, 0, 1)]))).where(F.col("band").between(0, bands - 1))
    n = cells(F.col("band"))
    own = F.least(F.floor(F.col("lon2") / 360 * n), n - 1).cast("int")
    b = b.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.pmod(own + k, n) for k in (-1, 0, 1)]))))
    sep = separation("lon1", "lat1", "lon2", "lat2")
    near = a.join(b, ["band", "cell"]).withColumn("sep", sep).where(F.col("sep") < radius)
    return near.groupBy(left_id).agg(F.min(F.struct("sep", right_id)).alias("m")).select(left_id, f"m.{right_id}", "m.sep")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, time: str, within: float, columns: list[str]) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time, if within ``within``; of equal ones the earlier.

    Two sorts per key: the last right row at or before and the first one at or after each left row are the only candidates.
    """
    carry = F.struct(F.col(time).alias("t2"), *[F.col(c) for c in columns])
    a = left.withColumns({"_right": F.lit(None).cast(right.select(carry.alias("s")).schema["s"].dataType), "_left": F.lit(True)})
    b = right.select(key, time, carry.alias("_right"), F.lit(False).alias("_left"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(time)
    back = F.last("_right", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # the first one ahead is the last one met when time runs backwards: both frames only ever grow
    turned = Window.partitionBy(key).orderBy(F.col(time).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.last("_right", ignorenulls=True).over(turned)
    out = both.withColumns({"_back": back, "_ahead": ahead}).where("_left")
    gap = lambda s: F.abs(F.col(time) - F.col(f"{s}.t2"))
    best = F.when(F.col("_ahead").isNull() | (gap("_back") <= gap("_ahead")), F.col("_back")).otherwise(F.col("_ahead"))
    out = out.withColumn("_best", best).where(F.abs(F.col(time) - F.col("_best.t2")) < within)
    return out.select(*left.columns, F.col("_best.t2").alias(f"nearest_{time}"), *[F.col(f"_best.{c}").alias(f"nearest_{c}") for c in columns])


def predecessor(points: DataFrame, index: DataFrame, value: str, start: str) -> DataFrame:
    """Each point with the index row whose start is the last one at or below its value. Starts are distinct.

    The points' distinct values and the index are dealt to ranges together, however they cluster; within a range the last start is carried
    along the order, and each range gets the last start before it. Points whose value is null or below all starts have no row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in index.columns])
    both = points.select(F.col(value).alias("_v"), F.lit(True).alias("_asks")).where("_v IS NOT NULL").distinct()
    both = both.unionByName(index.select(F.col(start).alias("_v"), F.lit(False).alias("_asks"), row.alias("_ix")).where("_v IS NOT NULL"), allowMissingColumns=True)
    ranges = durable(both.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()))
    own = F.last("_ix", ignorenulls=True).over(Window.partitionBy("_range").orderBy("_v", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # one row a range
    lasts = ranges.groupBy("_range").agg(F.max_by("_ix", F.when(~F.col("_asks"), F.col("_v"))).alias("_l"))
    before = lasts.select(F.col("_range"), F.last("_l", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    found = ranges.withColumn("_own", own).where("_asks").join(F.broadcast(before), "_range").select("_v", F.coalesce("_own", "_before").alias("_ix")).where("_ix IS NOT NULL")
    return points.join(found, F.col(value) == F.col("_v")).select(*[F.col(f"`{c}`") for c in points.columns], "_ix.*")


#: Levels of the cubes that a search goes through, at most, and right rows that a cube of the last level holds about.
LEVELS, CUBE_ROWS = 20, 8


def nearest_of_all(left: DataFrame, right: DataFrame, left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """left_id, right_id, sep of each left row's nearest right row at any distance, the whole sphere included; ties go to the smaller right id.

    The right rows' unit vectors lie in cubes, whose sides halve from level to level. A left row keeps the cubes that may hold its nearest: those
    no farther than the farthest point of the best one. Their parts of the next level are joined by number, until cubes hold a few rows.
    A side without rows gives none.
    """
    n = right.count()
    bottom = min(LEVELS, max(1, (n // CUBE_ROWS).bit_length() // 2 + 1))
    side = lambda level: 2.0 / (1 << level)

    def vector(df: DataFrame, name: str) -> DataFrame:
        lon, lat = F.radians("lon"), F.radians("lat")
        return df.select(F.col("id").alias(name), "lon", "lat", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")).where("lon IS NOT NULL AND lat IS NOT NULL")

    def place(level: int) -> list[Column]:
        return [F.least(F.floor((F.col(c) + 1) / side(level)), F.lit((1 << level) - 1)).cast("int").alias(f"c{c}") for c in "xyz"]

    a, b = durable(vector(left, left_id)), vector(right, right_id)
    b = durable(b.select(right_id, F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), *place(bottom)))
    up = lambda level: [F.shiftright(f"c{c}", bottom - level).alias(f"c{c}") for c in "xyz"]
    cubes = lambda level: b.select(*up(level)).distinct()
    near = None
    for level in range(min(2, bottom), bottom + 1):
        if near is None:
            # 64 cubes at most
            first = [F.struct(*[F.lit(r[f"c{c}"]).alias(f"c{c}") for c in "xyz"]) for r in cubes(level).collect()]
            if not first:
                return a.select(left_id, F.lit(None).cast(right.schema["id"].dataType).alias(right_id), F.lit(None).cast("double").alias("sep")).limit(0)
            near = a.select("*", F.inline(F.array(*first)))
        else:
            parts = cubes(level).select("*", *[F.shiftright(f"c{c}", 1).alias(f"p{c}") for c in "xyz"])
            near = near.drop("far").withColumnsRenamed({f"c{c}": f"p{c}" for c in "xyz"}).join(parts, [f"p{c}" for c in "xyz"]).drop("px", "py", "pz")
        low = {c: F.col(f"c{c}") * side(level) - 1 for c in "xyz"}
        gap = lambda c: F.greatest(F.lit(0.0), low[c] - F.col(c), F.col(c) - low[c] - side(level))  # noqa: E731, B023
        reach = lambda c: F.greatest(F.abs(F.col(c) - low[c]), F.abs(F.col(c) - low[c] - side(level)))  # noqa: E731, B023
        size = lambda f: F.sqrt(sum((f(c) * f(c) for c in "yz"), start=f("x") * f("x")))
        near = near.withColumns({"close": size(gap), "far": size(reach)})
        near = near.withColumn("far", F.min("far").over(Window.partitionBy(left_id, "lon", "lat"))).where(F.col("close") <= F.col("far") + 1e-12).drop("close")
        near = durable(near)
    met = near.join(b, ["cx", "cy", "cz"]).withColumn("sep", separation("lon", "lat", "lon2", "lat2"))
    return met.groupBy(left_id).agg(F.min(F.struct("sep", right_id)).alias("m")).select(left_id, f"m.{right_id}", "m.sep")


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, sep, forward: the nearest right row of each left row, and the nearest left row of each right row."""
    back = nearest_of_all(right, left, "right_id", "left_id").select("left_id", "right_id", "sep", F.lit(False).alias("forward"))
    return nearest_of_all(left, right).withColumn("forward", F.lit(True)).unionByName(back)


def match_catalogues(left: DataFrame, right: DataFrame, radius: float, years: float = 0.0, use_pm: bool = False) -> DataFrame:
    """``cross_match`` of two catalogues; with ``use_pm`` the right one's positions are moved by its proper motions (pm_lon, pm_lat, mas a year) over ``years`` first."""
    if use_pm:
        lon, lat = wrapped(*moved("lon", "lat", "pm_lon", "pm_lat", years))
        right = right.withColumns({"_lon": lon, "_lat": lat}).select("id", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    return cross_match(left, right, radius)


def grid_cell(points: DataFrame, lon: str, lat: str, lon0: float, lat0: float, size_lon: float, size_lat: float, n_lon: int, n_lat: int) -> DataFrame:
    """Number of the half-open grid box that holds each point, or null outside: integer arithmetic instead of a join."""
    i, j = F.floor((F.col(lon) - lon0) / size_lon), F.floor((F.col(lat) - lat0) / size_lat)
    inside = (i >= 0) & (i < n_lon) & (j >= 0) & (j < n_lat)
    return points.withColumn("cell", F.when(inside, i * n_lat + j).cast("long"))


def footprint_grid(spark: SparkSession, footprints: list[tuple[float, float, float, float, float, float]]) -> DataFrame:
    """cell, footprint, l, b, size_l, size_b: the boxes of all footprints (lon and lat from, to, and both sizes) numbered on, each by latitude, then longitude.

    Edges start at the first bound and stay below the second, and boxes lie between edges, so a last part that is not a whole box is left out. Longitudes may be negative.
    """
    parts, first = [], 0
    for k, (l0, l1, b0, b1, dl, db) in enumerate(footprints):
        wide, high = max(0, math.ceil((l1 - l0) / dl) - 1), max(0, math.ceil((b1 - b0) / db) - 1)
        i, j = F.col("id") % max(1, wide), F.floor(F.col("id") / max(1, wide))
        parts.append(spark.range(wide * high).select((F.col("id") + first).alias("cell"), F.lit(k).alias("footprint"), (l0 + (i + 0.5) * dl).alias("l"), (b0 + (j + 0.5) * db).alias("b"), F.lit(float(dl)).alias("size_l"), F.lit(float(db)).alias("size_b")))
        first += wide * high
    return functools.reduce(DataFrame.unionByName, parts)


def in_footprints(df: DataFrame, lon: str, lat: str, footprints: list[tuple[float, float, float, float, float, float]]) -> DataFrame:
    """``df`` with ``cell`` of ``footprint_grid``, a row for each footprint that a position lies in; others go. A box has its lower edges, longitudes count by the turn."""
    cells, first = [], 0
    for l0, l1, b0, b1, dl, db in footprints:
        wide, high = max(0, math.ceil((l1 - l0) / dl) - 1), max(0, math.ceil((b1 - b0) / db) - 1)
        i, j = F.floor(F.pmod(F.col(lon) - l0, F.lit(360.0)) / dl), F.floor((F.col(lat) - b0) / db)
        cells.append(F.when((i < wide) & (j >= 0) & (j < high), first + j * wide + i))
        first += wide * high
    return df.withColumn("cell", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())))
