"""Saved preparation, boosting, cells and the cascade; the registered model queries with held-out figures."""

from threading import Barrier
from unittest.mock import Mock

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from skyloom.operators import boosting, learning, preparation
from skyloom.plans import catalog, models


def sources(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        kind = k % 3
        phi, size = rng.normal(2 * kind, 0.3), float(np.exp(rng.normal(kind, 0.4)))
        rows.append((k, ["CONST", "EB", "RR"][kind], float(phi), size if k % 11 else None, float(rng.normal(kind)) if k % 17 else float("inf"), float(rng.normal())))
    rows[5] = (5, "RR", 4.0, 8.0, 2.0, 1e6)
    return spark.createDataFrame(rows, "sourceid long, var_class string, phi double, size double, colour double, noise double")


FEATURES = ["size", "colour", "noise", "phi_x", "phi_y"]
OPTIONS = {"id_col": "sourceid", "angles": ["phi"], "powered": ["size"], "no_upper": ["colour"]}


def test_feature_lists():
    assert len(preparation.BINARY_FEATURES) == 20 and len(preparation.VARIABLE_FEATURES) == len(set(preparation.VARIABLE_FEATURES)) == 86
    assert len(preparation.VARIABLE_POWERED) == 60 and len(preparation.ANGLES) == 12 and set(preparation.VARIABLE_NO_UPPER) <= set(preparation.VARIABLE_FEATURES)


def test_preparation_is_what_it_says(spark):
    df = sources(spark)
    model, rows = preparation.prepare(df, FEATURES, **OPTIONS)
    # the outlier leaves training only; nothing is null or infinite afterwards
    assert rows.where("sourceid = 5").isEmpty() and 390 <= rows.count() < 400
    out = model.transform(df)
    assert out.count() == 400 and out.where(" OR ".join(f"{c} IS NULL OR isnan({c}) OR abs({c}) = double('inf')" for c in FEATURES)).isEmpty()
    prepared = rows.select(*FEATURES).toPandas()
    assert np.allclose(prepared.median(), 0, atol=1e-9) and np.allclose(prepared.quantile(0.75) - prepared.quantile(0.25), 1, atol=1e-9)
    # a filled value is the mean of the five nearest training rows before scaling
    stages = dict(zip(("angles", "power", "clip", "imputer", "scaler"), model.stages, strict=True))
    lam, mean, dev = (stages["power"].getOrDefault(p)[0] for p in ("lambdas", "means", "deviations"))
    x = df.select("size").where("size IS NOT NULL").toPandas()["size"].to_numpy()
    y = np.log1p(x) if abs(lam) < 1e-9 else ((x + 1) ** lam - 1) / lam
    assert y.mean() == pytest.approx(mean) and y.std() == pytest.approx(dev)
    assert stages["clip"].getOrDefault("highs")[1] == float("inf") and stages["clip"].names() == ["size", "colour", "noise"]


@pytest.mark.parametrize("kind", [learning.Forest, learning.Boosted])
def test_saved_and_read_again(spark, tmp_path, kind):
    df = sources(spark)
    options = {"trees": 10, "depth": 4}
    trained = learning.Prepared(kind(FEATURES, "var_class", "CONST", **options), **OPTIONS).fit(df)
    trained.save(str(tmp_path / "m"))
    again = learning.Prepared.load(str(tmp_path / "m"), kind)
    assert isinstance(again.preparation, PipelineModel)
    one, two = (m.predict(df).select("sourceid", "class", "prob", "prob_var").orderBy("sourceid").collect() for m in (trained, again))
    assert one == two and len(one) == 400
    assert trained.predict(df).columns == [*df.columns, "class", "prob", "prob_var"]
    assert sum(r["class"] == ["CONST", "EB", "RR"][r["sourceid"] % 3] for r in one) > 360 and all(0 <= r["prob_var"] <= 1 for r in one)


def test_boosting_is_calibrated(spark):
    """Margins whose classes overlap: probabilities agree with the share of rows that are right, on rows that were not seen."""
    rng = np.random.default_rng(2)
    rows = [(k, "ab"[int(rng.random() < 1 / (1 + np.exp(-2 * x)))], float(x)) for k, x in enumerate(rng.normal(size=1200))]
    df = spark.createDataFrame(rows, "sourceid long, kind string, x double").withColumn("y", F.col("x") * 0)
    train, rest = df.where("sourceid < 800"), df.where("sourceid >= 800")
    out = learning.Boosted(["x", "y"], "kind", trees=8, depth=2).fit(train).predict(rest).toPandas()
    right = out["class"] == out["kind"]
    assert right.mean() > 0.72 and abs(out["prob"].mean() - right.mean()) < 0.08


def test_cells_are_trained_once(spark, tmp_path):
    df = sources(spark, 240).withColumn("cell", F.col("sourceid") % 4)
    made = []

    def make():
        made.append(1)
        return learning.Forest(["noise", "phi"], "var_class", "CONST", trees=3, depth=3)

    folder = str(tmp_path / "cells")
    # cells 2 and 3 break off: the first run leaves two finished ones
    with pytest.raises(ZeroDivisionError):
        learning.train_cells(df, "cell", lambda: make() if len(made) < 2 else 1 / 0, folder, parallel=1)
    assert len(made) == 2
    paths = learning.train_cells(df, "cell", make, folder, parallel=3)
    assert len(made) == 4 and sorted(paths) == [0, 1, 2, 3]
    learning.train_cells(df, "cell", make, folder)
    assert len(made) == 4
    models = {k: learning.Forest.load(path) for k, path in paths.items() if k != 3} | {9: None}
    out = learning.by_cell(df, "cell", models)
    assert out.count() == 180 and out.where("cell = 3").isEmpty()
    alone = models[1].predict(df.where("cell = 1")).select("sourceid", "class", "prob").orderBy("sourceid").collect()
    assert out.where("cell = 1").select("sourceid", "class", "prob").orderBy("sourceid").collect() == alone
    assert learning.by_cell(df, "cell", {}).isEmpty() and learning.by_cell(df.limit(0), "cell", models).isEmpty()


@pytest.mark.parametrize("name", ["classify_cascade", "models_by_cell", "boosted_predictions"])
def test_registered_models(spark, sf_dir, name):
    """The given vectors tell nothing of their labels, so classes are checked for form: every row once, probabilities, the cascade's cuts."""
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    ids = {r["vec_id"] for r in rows}
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert len(ids) == len(rows) > 0 and all(0 < r["prob"] <= 1 for r in rows)
    if name == "classify_cascade":
        assert all(r["class_nofap"] != "CONST" and r["prob_1st_stage"] > 0.5 for r in rows)
    else:
        assert len(rows) == n and {r["class"] for r in rows} <= {str(r["label"]) for r in rows}


@pytest.mark.parametrize("kind", [learning.Forest, learning.Boosted])
def test_partitions_of_a_fit_follow_its_rows(spark, monkeypatch, kind):
    """However a table is dealt, and with every class's weight as ``balanced_weights`` has it; no join, which would deal rows by class."""
    df = sources(spark).where("sourceid % 3 < 2 OR sourceid % 2 = 0").repartition(40)
    one = kind(["colour", "noise", "phi"], "var_class", "CONST")
    rows = one._indexed(df)
    assert "Join" not in rows._jdf.queryExecution().toString() and rows.rdd.getNumPartitions() == 4
    own = {r["sourceid"]: r["weight"] for r in rows.select("sourceid", "weight").collect()}
    assert own == {r["sourceid"]: r["weight"] for r in learning.balanced_weights(df, "var_class").collect()} and len(set(own.values())) > 1
    monkeypatch.setattr(learning, "PART_ROWS", 30)
    assert one._indexed(df).rdd.getNumPartitions() == -(-len(own) // 30) > 4


def test_folds_are_fitted_side_by_side(spark):
    """Fits meet in a barrier, two by two; every row comes once, from a model of all other folds."""
    df, both = sources(spark, 90), Barrier(2, timeout=30)

    class Told:
        def fit(self, rows):
            both.wait()
            self.seen = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
            return self

        def predict(self, rows):
            return rows.withColumns({"seen": F.array(*map(F.lit, self.seen)), "n": F.lit(sum(self.seen.values()))})

    out = learning.cross_validated(df, Told, "sourceid", 4).collect()
    assert sorted(r["sourceid"] for r in out) == list(range(90))
    assert all(sorted([*r["seen"], r["fold"]]) == [0, 1, 2, 3] and r["n"] == 90 - sum(o["fold"] == r["fold"] for o in out) for r in out)


def test_validation_does_not_depend_on_how_rows_are_dealt(spark):
    df = sources(spark, 200)
    one, two = (learning.cross_validated(rows, lambda: learning.Forest(["noise", "phi"], "var_class", trees=3, depth=3), "sourceid", 2) for rows in (df.repartition(7), df.repartition(3, "noise")))
    assert sorted(map(tuple, one.select("sourceid", "class", F.round("prob", 9)).collect())) == sorted(map(tuple, two.select("sourceid", "class", F.round("prob", 9)).collect()))


def test_boosted_predictions_has_every_tree(monkeypatch):
    """The survey's 100 rounds of trees of depth 8 and its other settings, on whole halves."""
    made = []
    monkeypatch.setattr(models, "vectors", lambda spark, d: None)
    monkeypatch.setattr(learning, "cross_validated", lambda v, make, *rest: made.append((make(), rest)) or Mock())
    catalog.QUERIES["boosted_predictions"](None, None)
    ((one, rest),) = made
    assert one.features == models.FEATURES and rest == ("vec_id", 2)
    s = one.settings
    assert (s.trees, s.depth, s.rate, s.child, s.gain, s.ridge, s.rows, s.features) == (100, 8, 0.15, 3, 2, 1, 0.8, 0.9)


def grown_plainly(x, y, w, classes, s):
    """Margins of boosting by loops over nodes, features, sides of missing values and cuts."""
    margins = np.zeros((classes, len(y)))
    for _ in range(s.trees):
        p = np.exp(margins) / np.exp(margins).sum(axis=0)
        for k in range(classes):
            g, h = (np.rint(v * boosting.SCALE) / boosting.SCALE for v in ((p[k] - (y == k)) * w, 2 * p[k] * (1 - p[k]) * w))

            def grow(rows, depth):
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.ridge)  # noqa: E731, B023
                best = (s.gain, None)
                for f in range(x.shape[1]) if depth < s.depth else ():
                    gone = np.isnan(x[rows, f])
                    for on_left in (True, False):
                        for cut in np.unique(x[rows, f][~gone]):
                            left = np.where(gone, on_left, x[rows, f] <= cut)
                            a, b = rows[left], rows[~left]
                            if h[a].sum() >= s.child and h[b].sum() >= s.child:  # noqa: B023
                                gain = score(a) + score(b) - score(rows)
                                best = max(best, (gain, (a, b)), key=lambda v: v[0] + 1e-9 * (v is best))
                if best[1] is None:
                    margins[k, rows] += -s.rate * g[rows].sum() / (h[rows].sum() + s.ridge)  # noqa: B023
                else:
                    for part in best[1]:
                        grow(part, depth + 1)

            grow(np.arange(len(y)), 0)
    return margins


def test_boosting_equals_plain_loops(spark, monkeypatch):
    """Features of few values, missing ones among them; blocks, partitions and the rows' order change nothing."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 9, 150), rng.normal(size=150).round(1), rng.integers(-3, 3, 150) / 7]).T.astype(float)
    y = ((x[:, 0] > 4) + (x[:, 2] > 0) * (x[:, 1] > 0.3) + (rng.random(150) < 0.3)).astype(int) % 3
    x[rng.random(150) < 0.15, 0] = np.nan
    x[rng.random(150) < 0.1, 2] = np.nan
    x[:, 1] = np.clip(x[:, 1], -1.4, 1.4)
    w = rng.integers(1, 4, 150) / 2
    s = boosting.Settings(trees=3, depth=3, rate=0.3, child=0.4, gain=0.01, rows=1.0, features=1.0)
    df = spark.createDataFrame([(k, *(None if np.isnan(v) else float(v) for v in x[k]), int(y[k]), float(w[k])) for k in range(150)], "id long, a double, b double, c double, y int, w double")
    df = df.withColumn("c", F.when(F.col("id") % 2 == 0, F.coalesce("c", F.lit(float("inf")))).otherwise(F.col("c")))
    plain = grown_plainly(x, y, w, 3, s)
    want = (np.exp(plain) / np.exp(plain).sum(axis=0)).T
    assert want.max() > 0.5 and len({tuple(r) for r in want.round(9)}) > 12
    fitted = []
    for rows, block in ((df, 40_000), (df.repartition(9), 20), (df.orderBy("b").coalesce(2), 7)):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        rounds = boosting.fit(rows, ["a", "b", "c"], "y", "w", "id", 3, 150, s)
        assert np.allclose(boosting.probabilities(rounds, 3, x.T), want, atol=1e-9)
        fitted.append([[v.tolist() for v in (t.feature, t.cut, t.missing, t.left, t.value)] for trees in rounds for t in trees])
    assert fitted[0] == fitted[1] == fitted[2]


def test_bins_hold_equal_shares(spark):
    """Ends of bins are near quantiles, whatever the values' scale; two values have one end, however rare one is."""
    rng = np.random.default_rng(3)
    columns = [rng.normal(size=4000), np.exp(8 * rng.normal(size=4000)), np.where(rng.random(4000) < 0.9, 0.0, 1e-300)]
    blocks = spark.sparkContext.parallelize([(np.stack([c[k::5] for c in columns]),) for k in range(5)], 3)
    cuts = boosting._cuts(blocks, 3)
    for values, cut in zip(columns[:2], cuts, strict=False):
        assert len(cut) == boosting.BINS - 1 and np.allclose([(values <= c).mean() for c in cut], np.arange(1, boosting.BINS) / boosting.BINS, atol=0.002)
    assert len(cuts[2]) == 1 and 0 <= cuts[2][0] < 1e-300


def test_rows_drawn_follow_their_key():
    key = np.arange(50_000).astype(np.uint64)
    one, two = boosting._drawn(key, 42, 0, 1) < 0.8, boosting._drawn(key, 42, 1, 1) < 0.8
    assert abs(one.mean() - 0.8) < 0.01 and abs((one & two).mean() - 0.64) < 0.01 and (boosting._drawn(key[::-1], 42, 0, 1)[::-1] < 0.8).tolist() == one.tolist()
