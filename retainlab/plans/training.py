"""Training plan: features -> split -> prep -> fitted model -> saved bundle (all fits: ``lifecycle``).

The students with their split are stored once as Parquet; the matrix (id, split, label,
features vector) is columns of them, computed where a fit reads it, so memory is left to
the fits, which keep what they need.  Folds are dealt only for the searches and runs that
use them.  ``fit_scope='all'`` reproduces the reference's prep
fitted before the split; ``'train'`` (default) fits it on training rows only.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.operators import models as md
from retainlab.operators import prep as pp
from retainlab.operators import split as sp
from retainlab.plans.q_prep import CAT, NUM, split_students
from retainlab.session import shared_path, stored
from retainlab.sources.files import path_exists
from retainlab.sources.fixture import ID, LABEL, memo_plan


@dataclass
class Prepared:
    rows: DataFrame          # stored students with their split (and fold, where ids repeat)
    features: md.FeatureTransformer
    prep: pp.PrepModel
    n_train: int = 0
    _data: DataFrame | None = None
    _folded: DataFrame | None = None

    def _matrix(self, rows: DataFrame, *keep: str) -> DataFrame:
        return self.prep.transform(self.features.transform(rows)).select(
            ID, "split", *keep, F.col(LABEL).cast("double").alias("label"), "features")

    @property
    def data(self) -> DataFrame:
        """id, split, label, features: columns of the stored rows, so nothing but these is kept."""
        if self._data is None:
            self._data = self._matrix(self.rows)  # the plan; building it takes seconds
        return self._data

    @property
    def folded(self) -> DataFrame:
        """:attr:`data` with the stratified ``fold`` of the training rows, dealt when first asked for."""
        if self._folded is None:
            rows = self.rows
            self._folded = rows if "fold" in rows.columns else stored(_dealt(rows))
        return self._matrix(self._folded, "fold")


def _dealt(rows: DataFrame) -> DataFrame:
    folds = sp.kfold(rows.where(F.col("split") == "train").select(ID, LABEL))
    return rows.join(folds.select(ID, "fold"), ID, "left")


def prepared(spark: SparkSession, sf: str, fit_scope: str = "train") -> Prepared:
    def build():
        raw = split_students(spark, sf)
        in_train = F.col("split") == "train"
        fstage = md.frozen_feature_stage(raw.where(in_train) if fit_scope == "train" else raw)
        if not sp.identified(raw):
            raw = stored(_dealt(raw))  # a repeated id meets the folds of all its rows
        f = fstage.transform(raw)
        prep = pp.fit_prep(f.where(in_train) if fit_scope == "train" else f, NUM, CAT, output_col="features", keep_input=False)
        return Prepared(raw, fstage, prep, raw.where(in_train).count())
    return memo_plan(spark, ("prepared", sf, fit_scope), build)


def fit_model(p: Prepared, name: str):
    train = p.data.where(F.col("split") == "train")
    if name in md.DEEP_TREES:
        train = train.coalesce(max(1, train.sparkSession.sparkContext.defaultParallelism))
    return md.make_estimator(name, p.n_train).fit(train)


def predictions(p: Prepared, name: str) -> DataFrame:
    """Fit one model on the training split; probabilities for every row."""
    return md.predict(fit_model(p, name), p.data, keep=(ID, "split", "label"))


LR_GRID_C = [0.001, 0.01, 0.1, 1, 10, 100]
LR_GRID_PENALTY = ["l1", "l2"]


def grid_search_logistic(p: Prepared, parallelism: int = 4) -> DataFrame:
    """M12 for logistic regression: C x penalty, 5 stratified folds, exact AUC.

    ``solver`` has no Spark counterpart (one optimiser serves all), so the 24
    combinations of the reference collapse to 12 distinct fits per fold.
    """
    train = p.folded.where(F.col("split") == "train").withColumn("fold", F.col("fold").cast("int"))
    lr = md.logistic(p.n_train)
    grid = []
    for C in LR_GRID_C:
        for pen in LR_GRID_PENALTY:
            grid.append({lr.regParam: 1.0 / (C * p.n_train), lr.elasticNetParam: 1.0 if pen == "l1" else 0.0})
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability",
                                       metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev, foldCol="fold", numFolds=5,
                        parallelism=parallelism, seed=md.SEED)
    model = cv.fit(train)
    rows = [(float(C), pen, float(m)) for (C, pen), m in
            zip([(C, pen) for C in LR_GRID_C for pen in LR_GRID_PENALTY], model.avgMetrics)]
    spark = p.data.sparkSession
    return spark.createDataFrame(rows, "C double, penalty string, mean_cv_roc_auc double")


def param_grid(name: str, est) -> list:
    """The reference's grids mapped onto Spark params (RF 108 -> 27, boosted 81 -> 81)."""
    b = ParamGridBuilder()
    if name == "Random Forest":
        # max_depth None -> Spark's cap 30; min_samples_split has no counterpart
        b = b.addGrid(est.numTrees, [50, 100, 200]).addGrid(est.maxDepth, [10, 20, 30]) \
            .addGrid(est.minInstancesPerNode, [1, 2, 4])
    elif name == "XGBoost":
        b = b.addGrid(est.maxIter, [50, 100, 200]).addGrid(est.maxDepth, [3, 6, 9]) \
            .addGrid(est.stepSize, [0.01, 0.1, 0.2]).addGrid(est.subsamplingRate, [0.8, 0.9, 1.0])
    else:
        return []
    return b.build()


# ------------------------------------------------------------------ persistence

def scoring_pipeline(p: Prepared, model) -> PipelineModel:
    """One PipelineModel -- frozen features -> prep -> model."""
    return PipelineModel(stages=[p.features, p.prep, model])


def save_bundle(spark: SparkSession, pipeline: PipelineModel, name: str, metrics: dict,
                path: str | None = None) -> str:
    """Save the pipeline as the model's next version and add its row to the registry table."""
    path = path or shared_path(spark, f"models/{uuid.uuid4().hex}")
    version = 1 + (versions(spark, path).where(F.col("model_name") == name).count()
                   if path_exists(spark, f"{path}/registry") else 0)
    pipeline.write().save(_bundle(path, name, version))
    # the registry row comes last: a version without one was not completed and is never read
    info = [(name, version, f"1.0.{version - 1}", len(pipeline.stages[1].feature_names()),
             time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()), json.dumps(metrics))]
    spark.createDataFrame(info, "model_name string, version int, model_version string, feature_count int, "
                                "last_trained string, metrics string") \
        .write.mode("append").parquet(f"{path}/registry")
    return path


def _bundle(path: str, name: str, version: int) -> str:
    return f"{path}/{name.replace(' ', '_')}/v{version}"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All saved versions of all models of a registry."""
    return spark.read.parquet(f"{path}/registry")


def load_bundle(spark: SparkSession, path: str, name: str, version: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """The pipeline of a model's version (the latest if none is named) and its registry row."""
    rows = versions(spark, path).where(F.col("model_name") == name)
    found = [r["version"] for r in rows.select("version").collect()]  # one row per saved version
    if not found or (version is not None and version not in found):
        raise ValueError(f"no saved version of {name!r}" + (f" {version}" if version is not None else ""))
    version = max(found) if version is None else version
    return PipelineModel.load(_bundle(path, name, version)), rows.where(F.col("version") == version)


def model_info(spark: SparkSession, path: str, model_name: str | None = None) -> DataFrame:
    """Registry lookup -> metadata of the latest version, metrics as long rows."""
    reg = versions(spark, path)
    last = reg.groupBy("model_name").agg(F.max("version").alias("version"))
    reg = reg.join(last, ["model_name", "version"], "left_semi")
    if model_name:
        reg = reg.where(F.col("model_name") == model_name)
    m = F.from_json("metrics", "map<string,double>")
    return reg.select("model_name", "model_version", "feature_count", "last_trained",
                      F.explode(m).alias("metric", "value"))
