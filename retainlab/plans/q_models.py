"""Registered queries: fitted models (M1-M9, M12, M13) and persistence.

Fitted coefficients and trees are not reproducible in SQL, so most of these
queries get the driver's rows-only check; naive Bayes and nearest neighbours have
SQL twins.  ``tests/test_training.py`` holds the AUC of every model against a
floor and every saved model against its reloaded copy.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.operators import metrics as mt
from retainlab.operators import models as md
from retainlab.operators import scoring as sc
from retainlab.plans import training as tr
from retainlab.plans.oracle import FEATURES, STUDENTS, with_
from retainlab.plans.q_prep import CAT, CATEGORY_DOMAINS, FEATURE_NAMES, NUM, SPLIT_SQL, prep_ctes
from retainlab.plans.registry import query, round_doubles
from retainlab.plans.lifecycle import TrainingRun
from retainlab.session import once
from retainlab.sources.fixture import ID, LABEL, memo_plan, students


# The prepared matrix in SQL: features and prep fitted on the training split, columns x0, x1, ...
TRAIN_FEATURES = FEATURES.replace("FROM f1_)", "FROM f1_ JOIN split_ USING (student_id) WHERE split_.split = 'train')")
MATRIX = [STUDENTS, SPLIT_SQL, TRAIN_FEATURES,
          "fit_ AS (SELECT features.* FROM features JOIN split_ USING (student_id) WHERE split = 'train')", *prep_ctes("fit_"),
          "mat_ AS (SELECT features.student_id, split_.split, dropout_status::DOUBLE AS label, " + ", ".join(
              [f"(coalesce(CAST(features.{c} AS DOUBLE), med_.{c}) - mom_.m_{c}) / CASE WHEN mom_.s_{c} = 0 OR mom_.s_{c} IS NULL "
               f"THEN 1 ELSE mom_.s_{c} END AS x{i}" for i, c in enumerate(NUM)]
              + [f"CASE WHEN coalesce(features.{c}, mode_.{c}) = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x{len(NUM) + i}"
                 for i, (c, v) in enumerate((c, v) for c in CAT for v in CATEGORY_DOMAINS[c])])
          + " FROM features JOIN split_ USING (student_id), med_, mom_, mode_)"]
WIDTH = len(FEATURE_NAMES)

NB_SQL = with_(
    *MATRIX,
    "cls_ AS (SELECT label AS y, count(*)::DOUBLE AS n, " + ", ".join(
        f"avg(x{i}) AS m{i}, var_pop(x{i}) AS v{i}" for i in range(WIDTH)) + " FROM mat_ WHERE split = 'train' GROUP BY label)",
    "eps_ AS (SELECT 1e-9::DOUBLE * greatest(" + ", ".join(f"var_pop(x{i})" for i in range(WIDTH))
    + ") AS e, count(*)::DOUBLE AS n FROM mat_ WHERE split = 'train')",
    "jll_ AS (SELECT student_id, mat_.split, label, y, ln(cls_.n / eps_.n) - 0.5::DOUBLE * (" + " + ".join(
        f"ln(2 * pi() * (v{i} + e)) + (x{i} - m{i}) * (x{i} - m{i}) / (v{i} + e)" for i in range(WIDTH))
    + ") AS j FROM mat_, cls_, eps_)",
    "p_ AS (SELECT student_id, split, label, 1 / (1 + exp(least(700.0::DOUBLE, "
    "sum(CASE WHEN y = 0 THEN j ELSE -j END)))) AS p FROM jll_ GROUP BY ALL)",
    body="SELECT student_id, split, label, round(p, 6) AS probability, CAST(p > 0.5 AS INTEGER) AS prediction FROM p_")

KNN_SQL = with_(
    *MATRIX,
    "vec_ AS (SELECT student_id, split, label, [" + ", ".join(f"x{i}" for i in range(WIDTH)) + f"]::DOUBLE[{WIDTH}] AS x FROM mat_)",
    """near_ AS (
  SELECT q.student_id, q.split, q.label, list_avg(arg_min(t.label, array_distance(q.x, t.x), 5)) AS p
  FROM vec_ q, vec_ t WHERE t.split = 'train' GROUP BY ALL)""",
    body="SELECT student_id, split, label, round(p, 6) AS probability, CAST(p > 0.5 AS INTEGER) AS prediction FROM near_")


def _fit_query(name: str, model: str, sql: str | None = None):
    @query(name, sql)
    def _q(spark: SparkSession, sf: str) -> DataFrame:
        return round_doubles(tr.predictions(tr.prepared(spark, sf), model))
    _q.__doc__ = f"{model}: fitted on the training split, probabilities for every student."
    return _q


fit_logistic = _fit_query("fit_logistic", "Logistic Regression")
fit_forest = _fit_query("fit_forest", "Random Forest")
fit_gbt = _fit_query("fit_gbt", "Gradient Boosting")
fit_gbt_deep = _fit_query("fit_gbt_deep", "XGBoost")
fit_tree = _fit_query("fit_tree", "Decision Tree")
knn_score = _fit_query("knn_score", "K-Nearest Neighbors", KNN_SQL)
gaussian_nb = _fit_query("gaussian_nb", "Naive Bayes", NB_SQL)
fit_svm_rff = _fit_query("fit_svm_rff", "SVM")


@query("score_logistic")
def q_score_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """One PipelineModel (frozen features -> prep -> logistic) scoring raw rows."""
    p = tr.prepared(spark, sf)
    pipe = tr.scoring_pipeline(p, tr.fit_model(p, "Logistic Regression"))
    out = md.predict(pipe, students(spark, sf), keep=(ID,))
    return round_doubles(sc.score_frame(out, "probability"))


def trained(spark: SparkSession, sf: str) -> TrainingRun:
    """The session's run of all models over ``sf``; queries that read it share its fits."""
    return memo_plan(spark, ("run", sf), lambda: TrainingRun(spark, sf)).fit()


@query("train_models")
def q_train_models(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of all eight models on the validation and test splits, 5-fold CV AUC."""
    return round_doubles(trained(spark, sf).report())


@query("test_report")
def q_test_report(spark: SparkSession, sf: str) -> DataFrame:
    """The best model of the run on the test split: report by class with the confusion counts."""
    run = trained(spark, sf)
    return round_doubles(run.on_test(run.best()))


@query("tuned_logistic")
def q_tuned_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """The grid's best logistic regression put in the model's place, fitted again, judged on val and test."""
    run = memo_plan(spark, ("run", sf), lambda: TrainingRun(spark, sf))
    best = run.tune("Logistic Regression")
    report = run.retrained("Logistic Regression").fit().report()
    return round_doubles(report.select("*", F.lit(best["C"]).alias("C"), F.lit(best["penalty"]).alias("penalty")))


@query("grid_search")
def q_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Grid search (C x penalty) for logistic regression, 5 folds, exact AUC."""
    return round_doubles(tr.grid_search_logistic(tr.prepared(spark, sf)))


@query("model_info")
def q_model_info(spark: SparkSession, sf: str) -> DataFrame:
    """Save the logistic scoring bundle, reload it, look up its registry row."""
    p = tr.prepared(spark, sf)
    name, model = "Logistic Regression", tr.fit_model(p, "Logistic Regression")
    val = p.rows.where(F.col("split") == "val").withColumn("label", F.col(LABEL).cast("double"))

    def metrics(pipe: PipelineModel) -> dict:
        # stored: the plans of the exact AUC over the matrix's many expressions would not end
        pred = once(md.predict(pipe, val, keep=(ID, "label")))
        return mt.evaluate(pred, "label", "probability", "prediction").first().asDict()

    pipe = tr.scoring_pipeline(p, model)
    path = tr.save_bundle(spark, pipe, name, metrics(pipe))
    loaded, row = tr.load_bundle(spark, path, name)
    known, again = json.loads(row.first()["metrics"]), metrics(loaded)
    if any((again[m] is None) != (v is None) or v is not None and abs(again[m] - v) > 1e-9 for m, v in known.items()):
        raise ValueError(f"the reloaded {name!r} reaches {again}, not the registered {known}")
    info = tr.model_info(spark, path, name).withColumn("feature_count", F.lit(len(loaded.stages[1].feature_names())))
    return round_doubles(info.drop("last_trained"))
