"""Nearest at any distance and predecessors against plain loops; far, polar, antipodal, empty and clustered cases."""

import bisect

import numpy as np
import pytest

from skyloom.operators import joins

SKY = "id long, lon double, lat double"


def angle(a, b):
    u, v = (np.array([np.cos(np.radians(p[1])) * np.cos(np.radians(p[0])), np.cos(np.radians(p[1])) * np.sin(np.radians(p[0])), np.sin(np.radians(p[1]))]) for p in (a, b))
    return np.degrees(np.arctan2(np.linalg.norm(np.cross(u, v)), u @ v))


@pytest.mark.parametrize("case", ["spread", "corner", "antipode", "poles", "one"])
def test_nearest_at_any_distance(spark, case):
    rng = np.random.default_rng(1)
    whole = lambda n: list(zip(rng.uniform(0, 360, n).tolist(), np.degrees(np.arcsin(rng.uniform(-1, 1, n))).tolist(), strict=True))
    left, right = {
        "spread": (whole(60), whole(300)),
        # all on one side in a square of a thousandth of a degree
        "corner": (whole(40), [(10 + x / 1000, 20 + y / 1000) for x, y in rng.random((300, 2)).tolist()]),
        "antipode": ([(30.0, 40.0)], [(210.0, -40.0)]),
        "poles": ([(0.0, 90.0), (123.0, -90.0), (359.99, 0.0)], [(77.0, 89.9), (5.0, -89.0), (0.01, 0.0), (180.0, 0.0)]),
        "one": (whole(20), [(1.0, 1.0)]),
    }[case]
    a, b = (spark.createDataFrame([(k, *p) for k, p in enumerate(x)], SKY) for x in (left, right))
    got = {r["left_id"]: r for r in joins.nearest_of_all(a, b).collect()}
    assert len(got) == len(left)
    for k, p in enumerate(left):
        seps = [angle(p, q) for q in right]
        assert got[k]["sep"] == pytest.approx(min(seps), abs=1e-5) and seps[got[k]["right_id"]] == pytest.approx(min(seps), abs=1e-6)


def test_nearest_of_nothing(spark):
    one, none = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 3.0)], SKY), spark.createDataFrame([], SKY)
    assert joins.nearest_of_all(one, none).isEmpty() and joins.nearest_of_all(none, one).isEmpty()
    both = joins.both_ways(one, one).collect()
    assert sorted((r["left_id"], r["right_id"], r["forward"]) for r in both) == [(1, 1, False), (1, 1, True)]


def test_predecessors_of_clustered_starts(spark):
    """Starts in two narrow clusters a billion apart, points that repeat one value."""
    rng = np.random.default_rng(2)
    starts = sorted({*(rng.integers(0, 5000, 400)).tolist(), *(10**9 + rng.integers(0, 5000, 400)).tolist()})
    values = [starts[3]] * 300 + rng.integers(-10, 6000, 300).tolist() + (10**9 + rng.integers(-10, 6000, 300)).tolist() + [None, starts[0] - 1]
    index = spark.createDataFrame([(k, s) for k, s in enumerate(starts)], "k long, start long")
    points = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    got = {r["id"]: r["start"] for r in joins.predecessor(points, index, "v", "start").collect()}
    want = {i: starts[bisect.bisect_right(starts, v) - 1] for i, v in enumerate(values) if v is not None and v >= starts[0]}
    assert got == want
    assert joins.predecessor(points, index.limit(0), "v", "start").isEmpty()


def test_footprints_are_numbered_on(spark):
    from skyloom.operators import joins

    two = [(0.0, 3.0, -1.0, 1.5, 1.0, 1.0), (359.0, 361.5, 0.0, 2.1, 1.0, 0.5), (0.0, 0.5, 0.0, 1.0, 1.0, 1.0)]
    got = [tuple(r)[:4] for r in joins.footprint_grid(spark, two).orderBy("cell").collect()]
    # edges 0 1 2 by -1 0 1, then 359 360 361 by 0 to 2 in halves; the third has no whole box
    assert got == [(j * 2 + i, 0, i + 0.5, j - 0.5) for j in range(2) for i in range(2)] + [(4 + j * 2 + i, 1, 359.5 + i, 0.25 + 0.5 * j) for j in range(4) for i in range(2)]
    s = spark.createDataFrame([(1, 0.5, 0.25), (2, 359.5, 0.25), (3, 2.5, 0.0), (4, None, 0.0), (5, 1.0, -1.0)], "id long, lon double, lat double")
    assert sorted((r["id"], r["cell"]) for r in joins.in_footprints(s, "lon", "lat", two).collect()) == [(1, 2), (1, 5), (2, 4), (5, 1)]


def test_motions_over_a_pole(spark):
    from pyspark.sql import functions as F

    from skyloom.functions import sky

    s = spark.createDataFrame([(10.0, 91.0), (350.0, -92.0), (370.0, 45.0), (-10.0, 90.0), (20.0, 271.0), (None, 1.0)], "lon double, lat double")
    lon, lat = sky.wrapped(F.col("lon"), F.col("lat"))
    got = [(r[0], r[1]) for r in s.select(lon, lat).collect()]
    assert got == [(190.0, 89.0), (170.0, -88.0), (10.0, 45.0), (350.0, 90.0), (20.0, -89.0), (None, 1.0)]
