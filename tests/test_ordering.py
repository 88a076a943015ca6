"""Positions, running totals, bounded percentiles, joins and models against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import joins, learning, ordering, quantiles, series, storage


def test_rows_are_numbered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x"))
    rows = ordering.numbered(df, "x").collect()
    assert sorted((r["x"], r["row_index"]) for r in rows) == list(zip(sorted(r["x"] for r in rows), range(1000), strict=True))
    assert ordering.numbered(df.limit(0), "x").count() == 0


def test_running_totals(spark):
    df = spark.createDataFrame([(k, (k * k) % 11) for k in range(0, 300, 3)], "k long, v long")
    got = {r["k"]: r["s"] for r in ordering.running_total(df, "k", "v", "s", width=40).collect()}
    total = 0
    for k in range(0, 300, 3):
        total += (k * k) % 11
        assert got[k] == total


def test_percentiles_leave_out_what_is_not_finite(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.lognormal(size=4000)
    rows = [(k % 3, float(v)) for k, v in enumerate(x)] + [(0, float("nan")), (1, float("inf")), (2, None), (None, 1.0), (0, float("-inf")), (5, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    marks = [0.0, 0.001, 0.16, 0.5, 0.84, 1.0]
    got = quantiles.grouped_percentiles(df, "g", "v", marks, few=50)
    assert set(got) == {0, 1, 2, 5} and got[5] == [2.0] * 6
    for g in range(3):
        assert got[g] == pytest.approx(np.quantile(x[g::3], marks).tolist())
    wide = spark.createDataFrame([(1.7e308,), (-1.7e308,), (0.0,), (float("nan"),)], "v double")
    assert quantiles.exact_percentiles(wide, ["v"], [0.5], few=1) == {"v": [0.0]}
    assert quantiles.exact_percentiles(df.where("g > 9"), ["v"], [0.5]) == {"v": [None]}


def test_predecessors_and_nearest_neighbours(spark):
    starts = [3.0, 3.5, 9.0, 100.0, 1e6]
    index = spark.createDataFrame([(s, k) for k, s in enumerate(starts)], "start double, k long")
    values = [0.0, 3.0, 3.2, 3.5, 8.9, 9.0, 99.0, 5e5, 1e6, 2e9]
    got = {r["v"]: r["k"] for r in joins.predecessor(spark.createDataFrame([(v,) for v in values], "v double"), index, "v", "start").collect()}
    assert got == {v: max(k for k, s in enumerate(starts) if s <= v) for v in values if v >= 3}
    sky = "id long, lon double, lat double"
    a = spark.createDataFrame([(1, 10.0, 0.0), (2, 359.999, 0.0), (3, 200.0, -89.0)], sky)
    b = spark.createDataFrame([(11, 10.0002, 0.0), (12, 0.001, 0.0), (13, 90.0, 60.0)], sky)
    near = {(r["left_id"], r["right_id"]) for r in joins.nearest_of_all(a, b).collect()}
    assert near == {(1, 11), (2, 12), (3, 12)}
    moving = b.select("*", F.lit(-720.0).alias("pm_lon"), F.lit(0.0).alias("pm_lat"))
    assert joins.match_catalogues(a, moving, 1e-5, years=1.0, use_pm=True).select("left_id", "right_id").collect() == [(1, 11)]
    assert joins.match_catalogues(a, moving, 1e-5).count() == 0


def test_cubics_are_taken_out(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 900, 60))
    rows = [(1, k, float(x), float(3 + 0.01 * x - 2e-5 * x * x + 1e-8 * x**3), 0.1) for k, x in enumerate(t)]
    noise = rng.normal(size=60)
    rows += [(2, k, float(x), float(n), float(e)) for k, (x, n, e) in enumerate(zip(t, noise, rng.uniform(0.1, 0.4, 60), strict=True))]
    rows += [(3, 0, 1.0, 5.0, 0.1), (3, 1, 2.0, 7.0, 0.1), (4, 0, 1.0, None, 0.1)]
    got = series.without_cubic(spark.createDataFrame(rows, "sourceid long, event_id long, t double, mag double, emag double")).orderBy("sourceid", "event_id").collect()
    assert all(abs(r["residual"]) < 1e-9 for r in got if r["sourceid"] in (1, 3)) and len(got) == 122
    e = np.array([r["emag"] for r in got if r["sourceid"] == 2])
    fit = np.polynomial.Polynomial.fit(t, noise, 3, w=1 / e)
    assert [r["residual"] for r in got if r["sourceid"] == 2] == pytest.approx((noise - fit(t)).tolist(), abs=1e-9)


def test_a_period_is_found_on_the_own_grid(spark):
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 200, 150))
    rows = [(1, float(x), float(12 + 0.3 * np.sin(2 * np.pi * x / 0.37) + 0.02 * rng.normal()), 0.02) for x in t] + [(2, 1.0, 5.0, 0.1), (2, 2.0, 5.0, 0.1)]
    got = series.candidate_frequency(spark.createDataFrame(rows, "sourceid long, t double, mag double, emag double"), 0.001, 5.0).collect()
    assert len(got) == 1 and abs(got[0]["f"] - 1 / 0.37) < 0.001 and got[0]["power"] > 0.9 and got[0]["place"] == 1 and got[0]["log10_fap"] < -20
    z, d = got[0]["power"], 147
    gamma = math.sqrt(2 / d) * math.exp(math.lgamma(d / 2) - math.lgamma((d - 1) / 2))
    single, tau = (1 - z) ** (d / 2), gamma * 5.0 * math.sqrt(4 * math.pi) * float(np.std(t)) * (1 - z) ** ((d - 1) / 2) * math.sqrt(d / 2 * z)
    assert got[0]["log10_fap"] == pytest.approx(math.log10(single - (1 - single) * math.expm1(-tau)), rel=1e-6)


def test_models_are_saved_and_read(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(rng.normal() + 3 * (k % 2)), float(rng.normal()), "VAR" if k % 2 else "CONST") for k in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, kind string")
    model = learning.Forest(["a", "b"], "kind", "CONST", trees=10).fit(df)
    path = storage.new_folder(spark)
    model.save(path)
    again = learning.Forest.load(path)
    show = lambda m: m.predict(df).select("id", "class", "prob", "prob_var").orderBy("id").collect()
    assert show(model) == show(again) and again.importance()["a"] > again.importance()["b"]
    out = learning.by_cell(df.withColumn("cell", F.col("id") % 4), "cell", {0: model, 1: again})
    assert out.count() == 100
    both = learning.cascade(df, model, model, 0.5, second_nofap=again)
    assert both.where("class_nofap <> class").isEmpty() and {"prob_1st_stage", "prob_nofap"} <= set(both.columns)
