"""Model fitting and scoring (M1-M13) on Spark ML, plus three custom models.

* M1-M5: Spark ML estimators with the reference's hyper-parameters.
* M7 Gaussian naive Bayes: per-class mean / population variance in one
  map; the joint log-likelihood is a column expression.
* M8 RBF SVM, re-aimed: random Fourier features (Rahimi & Recht, 2007) computed
  by an Arrow UDF, ``LinearSVC`` on them, Platt scaling of
  cross-fitted margins by a one-feature ``LogisticRegression``.
* M6 K nearest neighbours: see :mod:`retainlab.operators.knn`.

All models read a ``features`` vector column and a double ``label``; every
fitted model exposes ``probability`` (positive class) via :func:`positive_probability`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LinearSVCModel,
                                       LogisticRegression, LogisticRegressionModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainlab.functions import features as fx
from retainlab.functions.columns import matrix, merge, moments_by
from retainlab.operators.persist import StateWritable

SEED = 42


# --------------------------------------------------------------- G1 transformer

class FeatureTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """G1: the 23 derived features as a pipeline stage (no Python UDF).

    ``maxBurden`` freezes the dataset maximum of the financial burden seen at
    fit time; NaN means "use the batch maximum" (the reference's behaviour).
    """

    maxBurden = Param(Params._dummy(), "maxBurden", "frozen max financial burden (NaN: batch)",
                      TypeConverters.toFloat)

    @keyword_only
    def __init__(self, maxBurden: float = float("nan")):
        super().__init__()
        self._setDefault(maxBurden=float("nan"))
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        mb = self.getOrDefault("maxBurden")
        return fx.engineer_features(df, None if mb != mb else mb)


def frozen_feature_stage(df_raw: DataFrame) -> FeatureTransformer:
    """Fit-time feature stage with the burden maximum of ``df_raw`` frozen."""
    burden = fx.financial_features(df_raw).agg(F.max("financial_burden")).first()[0]
    return FeatureTransformer(maxBurden=float("nan") if burden is None else float(burden))


# ------------------------------------------------------------- M1-M5 estimators

def logistic(n_train: int | None = None, C: float = 1.0, penalty: str = "l2") -> LogisticRegression:
    """M1: L2 logistic regression; C maps to regParam = 1 / (C * n); tolerance 1e-4 as the
    reference library's default."""
    reg = 1.0 / (C * max(n_train or 1, 1))
    return LogisticRegression(maxIter=1000, tol=1e-4, regParam=reg,
                              elasticNetParam=1.0 if penalty == "l1" else 0.0,
                              standardization=False, featuresCol="features", labelCol="label")


def random_forest(num_trees: int = 100, max_depth: int = 30, min_leaf: int = 1) -> RandomForestClassifier:
    """M2: 100 trees; unlimited depth is capped at Spark's maximum of 30."""
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_leaf,
                                  seed=SEED, featuresCol="features", labelCol="label", cacheNodeIds=True,
                                  checkpointInterval=10, maxMemoryInMB=512)


def gradient_boosting() -> GBTClassifier:
    """M3: 100 rounds, depth 3, learning rate 0.1."""
    return GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED,
                         featuresCol="features", labelCol="label")


def boosted_deep(n_rounds: int = 100, depth: int = 6, rate: float = 0.3,
                 subsample: float = 1.0) -> GBTClassifier:
    """M4 (re-aimed XGBoost defaults): 100 rounds, depth 6, rate 0.3."""
    return GBTClassifier(maxIter=n_rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
                         seed=SEED, featuresCol="features", labelCol="label")


def decision_tree() -> DecisionTreeClassifier:
    """M5: unlimited depth capped at 30."""
    return DecisionTreeClassifier(maxDepth=30, maxBins=256, seed=SEED,
                                  featuresCol="features", labelCol="label")


def positive_probability(df: DataFrame, col: str = "probability", out: str = "p") -> DataFrame:
    """M9: positive-class probability of a Spark ML classifier output."""
    return df.withColumn(out, vector_to_array(F.col(col))[1])


# ------------------------------------------------------------ M7 naive Bayes

class GaussianNB(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """M7: Gaussian naive Bayes with variance smoothing 1e-9 x largest variance."""

    varSmoothing = Param(Params._dummy(), "varSmoothing", "fraction of the largest variance added",
                         TypeConverters.toFloat)

    def __init__(self, varSmoothing: float = 1e-9):
        super().__init__()
        self._setDefault(varSmoothing=1e-9)
        self._set(varSmoothing=varSmoothing)

    def _fit(self, df: DataFrame) -> "GaussianNBModel":
        d = len(df.select("features").first()[0])
        # one map: the moments of every class; the last entry counts the rows
        known = moments_by(df, F.col("label"), F.concat(vector_to_array("features"), F.array(F.lit(1.0))), d + 1)
        by = {c: _mean_and_variance(x) for c, x in known.items()}
        eps = self.getOrDefault("varSmoothing") * max(
            float(v or 0.0) for v in _mean_and_variance([reduce(merge, x) for x in zip(*known.values())])[1])
        rows = {c: x[-1][0] for c, x in known.items()}
        n = sum(rows.values())
        m = GaussianNBModel()
        m._set(priors=[rows[c] / n if c in by else 0.0 for c in (0, 1)],
               means=[by[c][0] if c in by else [0.0] * d for c in (0, 1)],
               variances=[[v + eps for v in by[c][1]] if c in by else [1.0] * d for c in (0, 1)])
        return m


def _mean_and_variance(known: list[tuple]) -> tuple[list[float], list[float]]:
    """Means and population variances from moments whose last entry counts the rows; NaN for an entry with a NaN."""
    n = known[-1][0]
    full = [x if x[0] == n else (1, math.nan, math.nan) for x in known[:-1]]
    return [x[1] for x in full], [x[2] / x[0] for x in full]


class GaussianNBModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    priors = Param(Params._dummy(), "priors", "class priors", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "per-class means", TypeConverters.identity)
    variances = Param(Params._dummy(), "variances", "per-class smoothed variances", TypeConverters.identity)

    def __init__(self):
        super().__init__()

    def joint_log_likelihood(self, x: Column, c: int) -> Column:
        mu, var = self.getOrDefault("means")[c], self.getOrDefault("variances")[c]
        prior = self.getOrDefault("priors")[c]
        const = math.log(prior) if prior > 0 else float("-inf")
        const -= 0.5 * sum(math.log(2 * math.pi * v) for v in var)
        quad = None
        for i, (m, v) in enumerate(zip(mu, var)):
            t = (x[i] - F.lit(m)) * (x[i] - F.lit(m)) / F.lit(v)
            quad = t if quad is None else quad + t
        return F.lit(const) - 0.5 * quad

    def probability(self, values: str) -> Column:
        """Of the features as an array column."""
        x = F.col(values)
        j0, j1 = self.joint_log_likelihood(x, 0), self.joint_log_likelihood(x, 1)
        return 1 / (1 + F.exp(j0 - j1))

    def _transform(self, df: DataFrame) -> DataFrame:
        # columns of their own: written out in every term, the array would be unpacked again for each
        out = df.withColumn("_x", vector_to_array("features")).withColumn("_p", self.probability("_x"))
        p = F.col("_p")
        return out.withColumn("probability", array_to_vector(F.array(1 - p, p))) \
            .withColumn("prediction", (p > 0.5).cast("double")).drop("_x", "_p")


# -------------------------------------------------------------- M8 RFF + SVM

def _rff_udf(W: np.ndarray, b: np.ndarray):
    scale = math.sqrt(2.0 / W.shape[0])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def rff(xs: pa.Array) -> pa.Array:
        # the rows lie one after another in Arrow: no array object a row, in or out
        Z = matrix(xs, W.shape[1]) @ W.T
        Z += b
        np.cos(Z, out=Z)
        Z *= scale
        return pa.ListArray.from_arrays(np.arange(len(xs) + 1, dtype=np.int32) * W.shape[0], Z.ravel())
    return rff


class RFFSVM(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """M8: RBF-kernel SVM approximated with random Fourier features, with cross-fitted Platt scaling.

    The margins that the calibration learns from come from machines that have not seen the
    row: ``calibration_folds`` of them, each fitted without one fold (a hash of the features).
    Margins on a machine's own training rows would be too large and the probabilities too sure.
    """

    def __init__(self, n_components: int = 200, C: float = 1.0, seed: int = SEED, calibration_folds: int = 3):
        super().__init__()
        self.n_components, self.C, self.seed, self.calibration_folds = n_components, C, seed, calibration_folds

    def _svm(self, n: int) -> LinearSVC:
        return LinearSVC(featuresCol="rff", labelCol="label", regParam=1.0 / (self.C * max(n, 1)),
                         maxIter=100, tol=1e-3)  # tol: the reference library's SVC default

    def _fit(self, df: DataFrame) -> "RFFSVMModel":
        x = vector_to_array("features")
        d = len(df.select("features").first()[0])
        # gamma = 'scale': 1 / (d * Var(X)) over all matrix entries
        st = df.select(F.explode(x).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
        gamma = 1.0 / (d * st) if st > 0 else 1.0
        rng = np.random.default_rng(self.seed)
        model = RFFSVMModel()
        model.W = rng.normal(0.0, math.sqrt(2 * gamma), size=(self.n_components, d))
        model.b = rng.uniform(0, 2 * math.pi, size=self.n_components)
        # the solver makes many passes: keep the random features instead of recomputing them
        part = F.pmod(F.xxhash64(x), F.lit(max(self.calibration_folds, 1))).alias("_part")
        z = model._features(df).select("rff", "label", part).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = z.count()
            model.svm = self._svm(n).fit(z)
            margins = None
            for k in range(self.calibration_folds):
                rest = z.where(F.col("_part") != k)
                # a fold whose rest lacks a class (tiny or one-sided data) is calibrated on the whole machine
                own = self._svm(n).fit(rest) if rest.select("label").distinct().count() > 1 else model.svm
                part = _margin(own.transform(z.where(F.col("_part") == k)))
                margins = part if margins is None else margins.unionByName(part)
            margins = _margin(model.svm.transform(z)) if margins is None else margins
            model.platt = LogisticRegression(featuresCol="m", labelCol="label", regParam=0.0).fit(margins)
        finally:
            z.unpersist()
        return model


def _margin(scored: DataFrame) -> DataFrame:
    out = scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("prediction", "rawPrediction", "probability")
    return VectorAssembler(inputCols=["margin"], outputCol="m").transform(out).drop("margin")


class RFFSVMModel(Model, StateWritable):
    def __init__(self):
        super().__init__()
        self.W, self.b, self.svm, self.platt = np.zeros((0, 0)), np.zeros(0), None, None

    def _features(self, df: DataFrame) -> DataFrame:
        return df.withColumn("rff", array_to_vector(_rff_udf(self.W, self.b)(vector_to_array("features"))))

    def _transform(self, df: DataFrame) -> DataFrame:
        z = _margin(self.svm.transform(self._features(df)))
        return self.platt.transform(z).drop("rff", "m", "rawPrediction")

    def save_state(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w.tolist(), float(o)) for i, (w, o) in enumerate(zip(self.W, self.b))]
        spark.createDataFrame(rows, "i int, w array<double>, b double").write.parquet(f"{path}/frequencies")
        self.svm.write().save(f"{path}/svm")
        self.platt.write().save(f"{path}/platt")

    def load_state(self, spark: SparkSession, path: str) -> None:
        rows = spark.read.parquet(f"{path}/frequencies").orderBy("i").collect()
        self.W, self.b = np.array([r["w"] for r in rows]), np.array([r["b"] for r in rows])
        self.svm = LinearSVCModel.load(f"{path}/svm")
        self.platt = LogisticRegressionModel.load(f"{path}/platt")


# ----------------------------------------------------------------- registry

MODEL_ORDER = ["Logistic Regression", "Random Forest", "Gradient Boosting", "XGBoost",
               "Decision Tree", "K-Nearest Neighbors", "Naive Bayes", "SVM"]

#: Fits of many nodes: every partition sends the statistics of every node of a level, however few rows it has of it,
#: so these are fitted on a partition a core, not on as many as the input has files.
DEEP_TREES = ("Random Forest", "Decision Tree")


def make_estimator(name: str, n_train: int | None = None):
    from retainlab.operators.knn import KNNClassifier

    return {
        "Logistic Regression": lambda: logistic(n_train),
        "Random Forest": random_forest,
        "Gradient Boosting": gradient_boosting,
        "XGBoost": boosted_deep,
        "Decision Tree": decision_tree,
        "K-Nearest Neighbors": lambda: KNNClassifier(k=5),
        "Naive Bayes": GaussianNB,
        "SVM": RFFSVM,
    }[name]()


def load_model(name: str, path: str):
    """The fitted model ``name`` (of ``MODEL_ORDER``) saved at ``path``."""
    from pyspark.ml import classification as c
    from retainlab.operators.knn import KNNModel

    kinds = {"Logistic Regression": c.LogisticRegressionModel, "Random Forest": c.RandomForestClassificationModel,
             "Gradient Boosting": c.GBTClassificationModel, "XGBoost": c.GBTClassificationModel,
             "Decision Tree": c.DecisionTreeClassificationModel, "K-Nearest Neighbors": KNNModel,
             "Naive Bayes": GaussianNBModel, "SVM": RFFSVMModel}
    return kinds[name].load(path)


def scorer(model, scratch: Sequence[str] = ("rawPrediction", "probability", "prediction")):
    """A fitted model as a bulk function that adds its probability of class 1 as ``p``."""
    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop(*scratch)
    return score


def predict(model, df: DataFrame, keep: Sequence[str] = ("student_id", "label")) -> DataFrame:
    """(kept columns, probability of class 1, hard prediction at 0.5)."""
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.select(*keep, p.alias("probability"),
                      F.when(F.isnan(p) | p.isNull(), F.lit(0)).otherwise((p > 0.5).cast("int")).alias("prediction"))
