"""Preparation of features, classifiers and the two-stage cascade."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.expr import finite
from skyloom.operators import boosting
from skyloom.operators.quantiles import exact_percentiles
from skyloom.operators.storage import durable, new_folder

#: Training rows of a partition, and the least number of partitions. Each step of a fit sends a result and a table of nodes from every partition.
PART_ROWS, PARTS = 40_000, 4


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    """Yeo-Johnson transform; null stays null."""
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    up = F.when(F.abs(lam) > 1e-9, F.try_divide(F.pow(x + 1, lam) - 1, lam)).otherwise(F.log1p(x))
    down = F.when(F.abs(lam - 2) > 1e-9, -F.try_divide(F.pow(1 - x, 2 - lam) - 1, 2 - lam)).otherwise(-F.log1p(-x))
    return F.when(x >= 0, up).otherwise(down)


def _transformed(x: np.ndarray, lam: float) -> np.ndarray:
    """``yeo_johnson`` by numpy."""
    out, up = np.empty_like(x), x >= 0
    for own, power, sign in ((up, lam, 1.0), (~up, 2 - lam, -1.0)):
        log = np.log1p(sign * x[own])
        out[own] = sign * (np.expm1(power * log) / power if abs(power) > 1e-9 else log)
    return out


def fit_power(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float, float]]:
    """Per feature: the lambda of the largest likelihood with mean and deviation of the transformed values. Two grids, one pass over the rows each.

    A task passes on one row a feature and lambda: number, mean, squared sum about it and the logarithms' sum of its own rows.
    """
    wide = df.select(*[finite(c).alias(f"x{k}") for k, c in enumerate(features)])

    def best(grids: dict[str, list[float]]) -> dict[str, tuple[float, float, float]]:
        cells = [(k, lam) for k, c in enumerate(features) for lam in grids.get(c, [])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(cells), 4))
            for batch in batches:
                columns = [batch.column(k).drop_null().to_numpy() for k in range(len(features))]
                logs = [float((np.sign(x) * np.log1p(np.abs(x))).sum()) for x in columns]
                for at, (k, lam) in enumerate(cells):
                    if not len(columns[k]):
                        continue
                    y = _transformed(columns[k], lam)
                    n, m, sq, s = total[at]
                    gap, every = y.mean() - m, n + len(y)
                    total[at] = every, m + gap * len(y) / every, sq + ((y - y.mean()) ** 2).sum() + gap * gap * n * len(y) / every, s + logs[k]
            if total[:, 0].any():
                k, lam = zip(*cells, strict=True)
                yield pa.record_batch([pa.array(k, pa.int32()), pa.array(lam), *map(pa.array, total.T)], names=["k", "lam", "n", "m", "sq", "s"])

        rows = wide.mapInArrow(run, "k int, lam double, n double, m double, sq double, s double").where("n > 0")
        n, m = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
        about = rows.groupBy("k", "lam").agg(F.collect_list(F.struct("n", "m", "sq")).alias("all"), n.alias("n"), m.alias("m"), F.sum("s").alias("s"))
        # one entry a task
        v = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["sq"] + x["n"] * (x["m"] - F.col("m")) * (x["m"] - F.col("m"))) / F.col("n")
        like = about.withColumn("v", v).where("v > 0").withColumn("ll", -F.col("n") / 2 * F.log("v") + (F.col("lam") - 1) * F.col("s"))
        top = like.groupBy("k").agg(F.max_by(F.struct("lam", "m", "v"), F.struct("ll", "lam")).alias("b"))
        return {features[r["k"]]: (r["b"]["lam"], r["b"]["m"], r["b"]["v"] ** 0.5) for r in top.collect()}

    around = lambda mid, reach, step: [round(mid + k * step, 6) for k in range(-reach, reach + 1)]
    coarse = best({c: around(0.0, 20, 0.2) for c in features})
    return best({c: around(v[0], 10, 0.02) for c, v in coarse.items()}) if coarse else {}


def power_transform(df: DataFrame, fitted: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Transformed and standardised features; the transform is a plain expression."""
    return df.withColumns({c: (yeo_johnson(finite(c), lam) - m) / s for c, (lam, m, s) in fitted.items()})


def robust_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """Features minus their median over their interquartile range, by exact percentiles."""
    marks = exact_percentiles(df, features, [0.25, 0.5, 0.75])
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(marks[c][1]), F.lit(marks[c][2]) - F.lit(marks[c][0])) for c in features})


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = n / (classes * n of the class), from one small aggregate."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    n = n.withColumn("weight", F.sum("_n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_n"))).drop("_n")
    return df.join(n, label)


def _parts(rows: int) -> int:
    return max(PARTS, -(-rows // PART_ROWS))


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(df)


class _Classifier:
    """What the classifiers share: names of classes, class, prob (of the class) and prob_var (1 - P(constant class)), saving and loading."""

    reader: type

    def __init__(self, features: list[str], label: str, constant: str | None = None):
        self.features, self.label, self.constant = features, label, constant

    def _indexed(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("_text", F.col(self.label).cast("string"))
        indexer = StringIndexer(inputCol="_text", outputCol="_label", stringOrderType="alphabetAsc").fit(df)
        self.classes = list(indexer.labels)
        df = indexer.transform(df)
        # the balanced weights, as literals: a join would deal rows by class to as many partitions as a shuffle has
        n = {int(r["_label"]): r["count"] for r in df.groupBy("_label").count().collect()}
        self.rows = sum(n.values())
        weights = F.array(*[F.lit(self.rows / (len(n) * n[k]) if k in n else None).cast("double") for k in range(len(self.classes))])
        return _assembled(df.withColumn("weight", F.element_at(weights, F.col("_label").cast("int") + 1)), self.features).coalesce(_parts(self.rows))

    def _told(self, out: DataFrame) -> DataFrame:
        """``out`` has ``_p``, an array of probabilities by class; of equal ones the first class counts."""
        out = out.withColumns({"prob": F.array_max("_p"), "class": F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("_p", F.array_max("_p")).cast("int"))})
        if self.constant in self.classes:
            out = out.withColumn("prob_var", 1 - F.col("_p")[self.classes.index(self.constant)])
        return out.drop("_features", "_r", "_p", "_c")

    def save(self, path: str) -> None:
        """Writes the fitted model and what predictions need besides it; ``load`` reads both."""
        self.model.write().overwrite().save(f"{path}/model")
        about = {"features": self.features, "label": self.label, "constant": self.constant, "classes": self.classes}
        _session().createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, path: str):
        about = json.loads(_session().read.schema("about string").json(f"{path}/about").first()["about"])
        out = cls(about.pop("features"), about.pop("label"), about.pop("constant"))
        out.model = cls.reader.load(f"{path}/model")
        for name, value in about.items():
            setattr(out, name, value)
        return out


def _session() -> SparkSession:
    # other threads than the first have no active session
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Forest(_Classifier):
    """Balanced random forest."""

    reader = RandomForestClassificationModel

    def __init__(self, features: list[str], label: str, constant: str | None = None, trees: int = 100, depth: int = 8, seed: int = 42):
        super().__init__(features, label, constant)
        self.forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="weight", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed)

    def fit(self, df: DataFrame) -> Forest:
        self.model = self.forest.fit(self._indexed(df))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(_assembled(df, self.features))
        return self._told(out.withColumn("_p", vector_to_array("_p")))

    def importance(self) -> dict[str, float]:
        return dict(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True))


class Boosted(_Classifier):
    """Gradient boosting of several classes with balanced weights: a tree for each class and round on the gradients of their common softmax.

    Its values are the probabilities. Features' values go to bins; ``id_col``, which the trees don't see, draws each tree's rows. The defaults are the survey's.
    """

    COLUMNS = ["feature", "cut", "missing", "left", "value", "depth"]
    SCHEMA = "round int, class int, feature array<int>, cut array<double>, missing array<boolean>, left array<int>, value array<double>, depth int"

    def __init__(self, features: list[str], label: str, constant: str | None = None, id_col: str = "sourceid", trees: int = 100, depth: int = 8, rate: float = 0.15, seed: int = 42):
        super().__init__(features, label, constant)
        self.id_col, self.settings = id_col, boosting.Settings(trees, depth, rate, seed=seed)

    def fit(self, df: DataFrame) -> Boosted:
        rows = self._indexed(df)
        self.rounds = boosting.fit(rows, self.features, "_label", "weight", self.id_col, len(self.classes), self.rows, self.settings)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        shared, classes = df.sparkSession.sparkContext.broadcast(self.rounds), len(self.classes)

        @F.pandas_udf("array<double>")
        def told(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float) for c in columns])
            return pd.Series(list(boosting.probabilities(shared.value, classes, x)))

        return self._told(df.withColumn("_p", told(*[F.col(c).cast("double") for c in self.features])))

    def save(self, path: str) -> None:
        about = {"features": self.features, "label": self.label, "constant": self.constant, "classes": self.classes, "id_col": self.id_col}
        _session().createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").json(f"{path}/about")
        trees = [(n, k, *(np.asarray(getattr(t, c)).tolist() for c in self.COLUMNS)) for n, trees in enumerate(self.rounds) for k, t in enumerate(trees)]
        _session().createDataFrame(trees, self.SCHEMA).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> Boosted:
        about = json.loads(_session().read.schema("about string").json(f"{path}/about").first()["about"])
        out = cls(about.pop("features"), about.pop("label"), about.pop("constant"), about.pop("id_col"))
        out.classes = about["classes"]
        found = _session().read.schema(cls.SCHEMA).parquet(f"{path}/model").orderBy("round", "class").collect()
        trees = [boosting.Tree(*(np.array(r[c]) for c in cls.COLUMNS[:-1]), r["depth"]) for r in found]
        n = len(out.classes)
        out.rounds = [trees[at : at + n] for at in range(0, len(trees), n)]
        return out


class Prepared:
    """A classifier with the preparation of its features; both are saved. Prediction prepares rows but never clips them."""

    def __init__(self, classifier: _Classifier, **preparation):
        self.classifier, self.options = classifier, preparation

    def fit(self, df: DataFrame) -> Prepared:
        from skyloom.operators.preparation import prepare

        self.preparation, rows = prepare(df, self.classifier.features, **self.options)
        self.classifier.fit(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with class, prob and prob_var; its features stay as they were."""
        own = [c for c in df.columns]
        kept = df.select("*", F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
        out = self.classifier.predict(self.preparation.transform(kept))
        added = [c for c in ("class", "prob", "prob_var") if c in out.columns]
        return out.select("_row.*", *added)

    def save(self, path: str) -> None:
        self.preparation.write().overwrite().save(f"{path}/preparation")
        self.classifier.save(f"{path}/classifier")

    @classmethod
    def load(cls, path: str, kind: type[_Classifier]) -> Prepared:
        out = cls(kind.load(f"{path}/classifier"))
        out.preparation = PipelineModel.load(f"{path}/preparation")
        return out


def fold(id_col: str, folds: int) -> Column:
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % folds


def cross_validated(df: DataFrame, make, id_col: str, folds: int, parallel: int = 5) -> DataFrame:
    """Predictions of every row by a model that has not seen its fold.

    Rows are written once, dealt evenly by hash of the row's id; ``parallel`` folds are fitted side by side, since one fit alone leaves cores idle between its steps.
    """
    n = _parts(df.count())
    rows = durable(df.withColumn("fold", fold(id_col, folds)).repartition(n, F.xxhash64(id_col)).sortWithinPartitions(id_col))
    models = _in_threads(df.sparkSession, lambda k: make().fit(rows.where(F.col("fold") != k)), range(folds), min(parallel, folds))
    out = None
    for k, model in enumerate(models):
        part = model.predict(rows.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def with_significance(df: DataFrame, label: str, cut: float, constant: str = "CONST", fap: str = "log10_fap") -> DataFrame:
    """Training rows of the second stage: the constant class, and others whose false-alarm probability is below the cut."""
    return df.where((F.col(label) == constant) | (F.col(fap) < cut))


def cascade(df: DataFrame, first, second, threshold: float = 0.65, wanted: str = "VAR", second_nofap=None, constant: str | None = None) -> DataFrame:
    """Rows that the first model calls ``wanted`` with enough probability, classified by the second; the first's stays as prob_1st_stage.

    ``second_nofap``, a model trained without a significance cut (``with_significance``), gives class_nofap, prob_nofap and
    prob_var_nofap besides; rows that it calls ``constant`` are left out.
    """
    kept = first.predict(df).where((F.col("class") == wanted) & (F.col("prob") > threshold)).withColumnRenamed("prob", "prob_1st_stage").drop("class", "prob_var")
    if second_nofap:
        kept = second_nofap.predict(kept).withColumnsRenamed({"class": "class_nofap", "prob": "prob_nofap", "prob_var": "prob_var_nofap"})
        if constant is not None:
            kept = kept.where(F.col("class_nofap") != constant)
    return second.predict(kept)


def _done(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema("cell string").json(f"{path}/done").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _in_threads(spark: SparkSession, work: Callable, cells: Iterable, parallel: int) -> list:
    """``work(cell)`` in ``parallel`` driver threads, which only submit jobs: each in a scheduler pool of its own, so that they share executors."""

    def one(numbered_cell):
        number, cell = numbered_cell
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"cells-{number % parallel}")
        try:
            return work(cell)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(one), enumerate(cells)))


def _by_folder(df: DataFrame, cell: str, folder: str) -> list:
    """Writes ``df`` once, a folder for each cell; the cells that there are."""
    df.withColumn("_cell", F.col(cell)).where("_cell IS NOT NULL").repartition("_cell", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(16))).write.partitionBy("_cell").parquet(folder)
    return sorted(r[0] for r in _read(df, cell, folder).select("_cell").distinct().collect())


def _read(df: DataFrame, cell: str, folder: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema.add("_cell", df.schema[cell].dataType)).parquet(folder)


def train_cells(df: DataFrame, cell: str, make: Callable[[], Prepared | _Classifier], folder: str, parallel: int = 4) -> dict:
    """A model for each cell, saved to ``folder/cell=<cell>``; cells that are finished there are left alone, so a run can be started again.

    Training rows are written once by cell, and each fit reads its own folder. Returns the folder of each cell's model.
    """
    spark, rows = df.sparkSession, new_folder(df.sparkSession)
    cells = _by_folder(df, cell, rows)
    paths = {k: f"{folder}/cell={k}" for k in cells}

    def train(k) -> None:
        if not _done(spark, paths[k]):
            make().fit(_read(df, cell, rows).where(F.col("_cell") == k).drop("_cell")).save(paths[k])
            spark.createDataFrame([(str(k),)], "cell string").write.mode("overwrite").json(f"{paths[k]}/done")

    _in_threads(spark, train, cells, parallel)
    return paths


def by_cell(df: DataFrame, cell: str, models: dict, parallel: int = 4) -> DataFrame:
    """Predictions of each row by the model of its cell; rows of cells without one are left out, and without models there are no rows.

    Rows are written once by cell and each model reads its own folder, so scans don't grow with the cells. The first model's
    columns are those of the result.
    """
    spark = df.sparkSession
    rows, out = new_folder(spark), new_folder(spark)
    there = set(_by_folder(df, cell, rows)) if models else set()
    able = [k for k in models if k in there]
    if not able:
        return df.withColumns({"class": F.lit(None).cast("string"), "prob": F.lit(None).cast("double")}).limit(0)
    one = lambda k: models[k].predict(_read(df, cell, rows).where(F.col("_cell") == k).drop("_cell"))
    schema = one(able[0]).schema
    _in_threads(spark, lambda k: one(k).select(*schema.names).write.parquet(f"{out}/part={able.index(k)}"), able, parallel)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
