"""Positions on the sphere: separations, frames, proper motion and hierarchical pixels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.expr import col

#: Rotation from equatorial (ICRS) to galactic axes.
TO_GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)


def separation(lon1: str | Column, lat1: str | Column, lon2: str | Column, lat2: str | Column) -> Column:
    """Great-circle distance in degrees (haversine)."""
    a1, b1, a2, b2 = (F.radians(col(c)) for c in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin((a2 - a1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def in_cone(lon: str, lat: str, lon0: float, lat0: float, radius: float) -> Column:
    """Cone test; the plain range of latitudes before it is what a scan can push down."""
    slack = 1e-9
    return F.col(lat).between(lat0 - radius - slack, lat0 + radius + slack) & (separation(lon, lat, F.lit(lon0), F.lit(lat0)) < radius)


def in_box(lon: str, lat: str, lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> Column:
    """Box test; a box with lon_min > lon_max crosses zero longitude."""
    between = (F.col(lon) > lon_min) & (F.col(lon) < lon_max) if lon_min <= lon_max else (F.col(lon) > lon_min) | (F.col(lon) < lon_max)
    return between & (F.col(lat) > lat_min) & (F.col(lat) < lat_max)


def moved(lon: str, lat: str, pm_lon: str, pm_lat: str, years: float) -> tuple[Column, Column]:
    """Position after ``years`` of proper motion (mas a year, the first along the circle of latitude)."""
    mas = years / 3.6e6
    return F.col(lon) + F.col(pm_lon) * mas / F.cos(F.radians(lat)), F.col(lat) + F.col(pm_lat) * mas


def wrapped(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Positions that motions took beyond a pole or a full turn, as longitude (0..360) and latitude; the point stays the same."""
    turn = F.pmod(lat + 90, F.lit(360.0))
    over = turn > 180
    return F.pmod(F.when(over, lon + 180).otherwise(lon), F.lit(360.0)), F.when(over, 270 - turn).otherwise(turn - 90)


def galactic(ra: str, dec: str) -> tuple[Column, Column]:
    """Galactic longitude (0..360) and latitude in degrees."""
    a, d = F.radians(ra), F.radians(dec)
    v = (F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))
    x, y, z = (sum((F.lit(m) * c for m, c in zip(row, v, strict=True)), F.lit(0.0)) for row in TO_GALACTIC)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def galactic_motion(ra: str, dec: str, pm_ra: str, pm_dec: str) -> tuple[Column, Column]:
    """Proper motion along galactic longitude (times the cosine of latitude) and latitude, in the units given; null at the poles."""
    a, d, p, q = F.radians(ra), F.radians(dec), F.col(pm_ra), F.col(pm_dec)
    at = F.array(F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))
    by = F.array(-p * F.sin(a) - q * F.sin(d) * F.cos(a), p * F.cos(a) - q * F.sin(d) * F.sin(a), q * F.cos(d))
    turned = lambda v: F.array(*[m * v[0] + n * v[1] + o * v[2] for m, n, o in TO_GALACTIC])

    def along(v: Column) -> Column:
        x, y, z = (v["at"][k] for k in range(3))
        u, v, w = (v["by"][k] for k in range(3))
        rho = F.sqrt(x * x + y * y)
        return F.array(F.try_divide(x * v - y * u, rho), rho * w - z * F.try_divide(x * u + y * v, rho))

    motion = _let(F.struct(_let(at, turned).alias("at"), _let(by, turned).alias("by")), along)
    return motion[0], motion[1]


def light_travel(ra: Column, dec: Column, mjd: Column) -> Column:
    """Days that light needs from the observer to the Sun's centre plane: low-precision solar position, good to seconds."""
    n = mjd - 51544.5
    g = F.radians(357.528 + 0.9856003 * n)
    sun = F.radians(280.460 + 0.9856474 * n + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = math.radians(23.439)
    far = 1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g)
    a, d = F.radians(ra), F.radians(dec)
    along = F.cos(d) * F.cos(a) * F.cos(sun) + (F.cos(d) * F.sin(a) * math.cos(tilt) + F.sin(d) * math.sin(tilt)) * F.sin(sun)
    return -far * along * 499.004782 / 86400


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used there (Catalyst would write it out each time)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_pixel(df: DataFrame, name: str, lon: str, lat: str, level: int, nested: bool = True) -> DataFrame:
    """``df`` with the equal-area pixel of 12 * 4^level, in nested or ring order, by the published projection of the sphere on twelve diamonds.

    In the belt a pixel is known by its ascending and descending edge lines, in the caps by its place in a quarter.
    """
    side = 1 << level
    whole = lambda c: F.floor(c).cast("long")
    low = lambda c, m: c.bitwiseAND(F.lit(m))

    def lines(p: Column) -> Column:
        z, turn, quarter = p["z"], p["turn"], F.least(F.lit(3), F.floor(p["turn"])).cast("long")
        belt, part, reach = F.abs(z) <= 2 / 3, turn - quarter, side * F.sqrt(F.greatest(F.lit(0.0), 3 * (1 - F.abs(z))))
        edge = lambda inside, beyond: F.when(belt, whole(side * inside)).otherwise(F.least(F.lit(side - 1), F.floor(beyond * reach)).cast("long"))
        up, down = edge(0.5 + turn - 0.75 * z, part), edge(0.5 + turn + 0.75 * z, 1 - part)
        return F.struct(belt.alias("belt"), (z >= 0).alias("north"), turn.alias("turn"), quarter.alias("quarter"), up.alias("up"), down.alias("down"))

    def place(p: Column) -> Column:
        up, down, ip, im = p["up"], p["down"], F.shiftright(p["up"], level), F.shiftright(p["down"], level)
        face = F.when(ip == im, low(ip, 3).bitwiseOR(F.lit(4))).when(ip < im, low(ip, 3)).otherwise(low(im, 3) + 8)
        face = F.when(p["belt"], face).when(p["north"], p["quarter"]).otherwise(p["quarter"] + 8)
        x = F.when(p["belt"], low(down, side - 1)).when(p["north"], side - 1 - down).otherwise(up)
        y = F.when(p["belt"], side - 1 - low(up, side - 1)).when(p["north"], side - 1 - up).otherwise(down)
        return F.struct(face.alias("face"), x.alias("x"), y.alias("y"))

    def interleaved(p: Column) -> Column:
        bits = [F.shiftleft(low(F.shiftright(p[c], k), 1), 2 * k + odd) for k in range(level) for odd, c in enumerate("xy")]
        return p["face"] * side * side + sum(bits, F.lit(0).cast("long"))

    def ringed(p: Column) -> Column:
        ring = F.when(p["belt"], side + 1 + p["up"] - p["down"]).otherwise(p["up"] + p["down"] + 1)

        def numbered(k: Column) -> Column:
            along = F.pmod(F.shiftright(p["up"] + p["down"] - side + 2 - low(k, 1), 1), F.lit(4 * side))
            cap = F.least(whole(p["turn"] * k), 4 * k - 1)
            return F.when(p["belt"], 2 * side * (side - 1) + (k - 1) * 4 * side + along).when(p["north"], 2 * k * (k - 1) + cap).otherwise(12 * side * side - 2 * k * (k + 1) + cap)

        return _let(ring, numbered)

    start = F.struct(F.sin(F.radians(lat)).alias("z"), (F.pmod(col(lon), F.lit(360.0)) / 90).alias("turn"))
    pixel = _let(_let(start, lines), (lambda p: _let(place(p), interleaved)) if nested else ringed)
    return df.withColumn(name, F.when(col(lon).isNotNull() & col(lat).isNotNull(), pixel).cast("long"))


def at_level(pixel: str | Column, level: int, target: int) -> Column:
    """First nested pixel of a finer level, or the pixel of a coarser one."""
    return F.shiftleft(col(pixel), 2 * (target - level)) if target >= level else F.shiftright(col(pixel), 2 * (level - target))
