"""Preparation of features as stages that are fitted, saved and read again: angles, power transform, clip, imputer, scaler.

Fitted numbers are parameters of the models, so Spark's own readers and writers save them; the imputer keeps its donors as a table beside.
``prepare`` fits them in the order that training takes: the clip's bounds come from transformed values before anything is filled in,
every training row is a donor, rows out of bounds leave before the scaler. The clip is for training only: prediction keeps all rows.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.expr import finite
from skyloom.operators.imputing import donors_of, imputed
from skyloom.operators.learning import fit_power, yeo_johnson
from skyloom.operators.quantiles import exact_percentiles
from skyloom.operators.storage import durable

# Names of the features of the two classifiers, in the order of their columns.
BINARY_FEATURES = [
    "ks_stdev", "ks_mad", "ks_kurtosis", "ks_skew", "ks_eta", "ks_stetson_i", "ks_stetson_j", "ks_stetson_k",
    "ks_p100_p0", "ks_p99_p1", "ks_p95_p5", "ks_p84_p16", "ks_p75_p25", "ks_stdev_over_error", "ks_mad_over_error",
    "ks_p100_p0_over_error", "ks_p99_p1_over_error", "ks_p95_p5_over_error", "ks_p84_p16_over_error", "ks_p75_p25_over_error",
]
BINARY_NO_UPPER = ["ks_stetson_i"]
PAIRS = [(1, 0), (2, 0), (3, 0), (2, 1), (3, 1), (3, 2)]
ANGLES = [f"phi{i}_phi{j}{d}" for d in ("", "_double") for i, j in PAIRS]
RATIOS = [f"a{j}_a{i}{d}" for d in ("", "_double") for i in range(1, 4) for j in range(i)]
SCALES = [f"{b}_{x}" for b in "ZYJH" for x in ("scale", "model")]
VARIABLE_POWERED = [
    *BINARY_FEATURES, *[f"amp_{k}" for k in range(4)], *[f"amp_double_{k}" for k in range(4)],
    "amplitude", "beyondfrac", "normed_delta_loglik", "lsq_period", "max_pow", "max_phase_lag", "pow_mean_disp", "phase_lag_mean", "log10_fap",
    *RATIOS, "JK_col", "HK_col", *SCALES, "model_amplitude",
]
VARIABLE_FEATURES = [*VARIABLE_POWERED, "peak_ratio_model", "peak_ratio_data", *[f"{a}_{c}" for a in ANGLES for c in "xy"]]
VARIABLE_NO_UPPER = ["JK_col", "HK_col", "ks_stetson_i"]


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "feature columns, which are replaced", TypeConverters.toListString)

    def names(self) -> list[str]:
        return self.getOrDefault("columns")


def _floats(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toListFloat)


class Angles(_Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the cosine (_x) and sine (_y) of each column."""

    @keyword_only
    def __init__(self, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_{s}": f(finite(c)) for c in self.names() for s, f in (("x", F.cos), ("y", F.sin))})


class PowerModel(_Columns, Model, DefaultParamsReadable, DefaultParamsWritable):
    lambdas, means, deviations = _floats("lambdas", "exponents"), _floats("means", "of the transformed"), _floats("deviations", "of the transformed")

    @keyword_only
    def __init__(self, columns=None, lambdas=None, means=None, deviations=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = zip(self.names(), *(self.getOrDefault(p) for p in ("lambdas", "means", "deviations")), strict=True)
        return df.withColumns({c: (yeo_johnson(finite(c), lam) - m) / (s or 1.0) for c, lam, m, s in fitted})


class PowerTransform(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Yeo-Johnson transform of each column, standardised; a column that never changes keeps its values but for their mean."""

    @keyword_only
    def __init__(self, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PowerModel:
        names = self.names()
        found = fit_power(df, names)
        plain = df.agg(*[F.coalesce(F.avg(finite(c)), F.lit(0.0)).alias(c) for c in names if c not in found]).first() if len(found) < len(names) else {}
        fitted = [found.get(c) or (1.0, plain[c], 0.0) for c in names]
        return PowerModel(columns=names, lambdas=[x[0] for x in fitted], means=[x[1] for x in fitted], deviations=[x[2] for x in fitted])


class ClipModel(_Columns, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Bounds of training; ``transform`` leaves rows as they are, ``marked`` tells those within all bounds."""

    lows, highs = _floats("lows", "least values"), _floats("highs", "greatest values")

    @keyword_only
    def __init__(self, columns=None, lows=None, highs=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df

    def marked(self, df: DataFrame, name: str) -> DataFrame:
        out = [finite(c).between(a, b) | finite(c).isNull() for c, a, b in zip(self.names(), self.getOrDefault("lows"), self.getOrDefault("highs"), strict=True)]
        inside = F.lit(True)
        for one in out:
            inside &= one
        return df.withColumn(name, inside)


class Clip(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Bounds ``width`` times 0.25 (p95 - p5) about the median; columns of ``noUpper`` have no upper one, a column without values none."""

    noUpper = Param(Params._dummy(), "noUpper", "columns without an upper bound", TypeConverters.toListString)
    width = Param(Params._dummy(), "width", "reach in deviations", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, columns=None, noUpper=(), width=10.0):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ClipModel:
        names, width, endless = self.names(), self.getOrDefault("width"), float("inf")
        marks = exact_percentiles(df.select(*[finite(c).alias(c) for c in names]), names, [0.05, 0.5, 0.95])
        reach = {c: (m[1], width * 0.25 * (m[2] - m[0])) for c, m in marks.items() if m[1] is not None}
        low = [reach[c][0] - reach[c][1] if c in reach else -endless for c in names]
        high = [reach[c][0] + reach[c][1] if c in reach and c not in self.getOrDefault("noUpper") else endless for c in names]
        return ClipModel(columns=names, lows=low, highs=high)


class ScaleModel(_Columns, Model, DefaultParamsReadable, DefaultParamsWritable):
    medians, ranges = _floats("medians", "middle values"), _floats("ranges", "interquartile ranges")

    @keyword_only
    def __init__(self, columns=None, medians=None, ranges=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = zip(self.names(), self.getOrDefault("medians"), self.getOrDefault("ranges"), strict=True)
        return df.withColumns({c: (F.col(c) - m) / (w or 1.0) for c, m, w in fitted})


class RobustScale(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Columns less their exact median over their exact interquartile range; a range of zero divides by one."""

    @keyword_only
    def __init__(self, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ScaleModel:
        marks = exact_percentiles(df, self.names(), [0.25, 0.5, 0.75])
        known = [marks[c] if marks[c][1] is not None else [0.0, 0.0, 0.0] for c in self.names()]
        return ScaleModel(columns=self.names(), medians=[m[1] for m in known], ranges=[m[2] - m[0] for m in known])


class _DonorWriter(MLWriter):
    def __init__(self, model: ImputerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.donors.write.parquet(f"{path}/donors")


class _DonorReader(MLReader):
    def load(self, path: str) -> ImputerModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ImputerModel(donors=self.sparkSession.read.parquet(f"{path}/donors"))
        model._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(model, about)
        return model


class ImputerModel(_Columns, Model, MLReadable, MLWritable):
    """Nulls become the mean of the nearest donors that have a value."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)

    def __init__(self, donors: DataFrame, columns: list[str] | None = None, k: int | None = None):
        super().__init__()
        self.donors = donors
        self._set(columns=columns, k=k)

    def _transform(self, df: DataFrame) -> DataFrame:
        return imputed(df, self.names(), self.donors, self.getOrDefault("k"))

    def write(self) -> MLWriter:
        return _DonorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DonorReader()


class Imputer(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Every row of the fit that has any value is a donor; ``idCol`` settles ties."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "column that settles ties", TypeConverters.toString)

    @keyword_only
    def __init__(self, columns=None, idCol=None, k=5):  # noqa: N803
        super().__init__()
        self._set(**({"k": 5} | self._input_kwargs))

    def _fit(self, df: DataFrame) -> ImputerModel:
        return ImputerModel(donors_of(df, self.names(), self.getOrDefault("idCol")), self.names(), self.getOrDefault("k"))


def prepare(df: DataFrame, features: list[str], id_col: str, angles: list[str] = (), powered: list[str] = (), no_upper: list[str] = (), width: float = 10.0, k: int = 5) -> tuple[PipelineModel, DataFrame]:
    """The fitted preparation, and the training rows that it leaves, prepared.

    ``angles`` become cosine and sine columns first; those pairs are neither transformed nor clipped. ``features`` names the columns that
    a classifier takes, pairs included.
    """
    circle = {f"{a}_{s}" for a in angles for s in "xy"}
    stages, inside = [], "_inside"
    if angles:
        stages.append(Angles(columns=list(angles)))
        df = stages[-1].transform(df)
    df = durable(df.withColumns({c: finite(c) for c in features}))
    if powered:
        stages.append(PowerTransform(columns=list(powered)).fit(df))
        df = stages[-1].transform(df)
    stages.append(Clip(columns=[c for c in features if c not in circle], noUpper=list(no_upper), width=width).fit(df))
    df = stages[-1].marked(df, inside)
    df = durable(df)
    stages.append(Imputer(columns=list(features), idCol=id_col, k=k).fit(df))
    df = durable(stages[-1].transform(df).where(inside).drop(inside))
    stages.append(RobustScale(columns=list(features)).fit(df))
    return PipelineModel(stages), durable(stages[-1].transform(df))
