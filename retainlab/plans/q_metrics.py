"""Registered queries: evaluation aggregates (E1-E7, M10, M11) over fixed scorers.

Fitted models are not reproducible in SQL, so the oracle-checked metric
queries evaluate three fixed scorers of the student table -- the frozen
logistic scorer, the overall risk score (F23) and the risk-factor share --
side by side, exactly like the reference compares its fitted models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.operators import metrics as mt
from retainlab.operators import scoring as sc
from retainlab.operators import split as sp
from retainlab.plans.oracle import FEATURES, SCORED, STUDENTS, with_
from retainlab.plans.q_prep import SPLIT_SQL
from retainlab.plans.q_scoring import scored_df
from retainlab.plans.registry import query, round_doubles
from retainlab.session import once
from retainlab.sources.fixture import ID, LABEL

SCORERS = ["frozen_logistic", "overall_risk", "risk_factors"]


def scorer_table(spark: SparkSession, sf: str, folds: bool = False) -> DataFrame:
    """(model, model_order, student_id, dropout_status, [fold,] probability, prediction), derived once."""
    s = once(scored_df(spark, sf, keep=[LABEL, "overall_risk_score", "risk_factors_count"]))
    keys = [ID, LABEL]
    if folds:
        s, keys = once(sp.kfold(s, LABEL, ID)), [*keys, "fold"]
    probs = [F.col("dropout_probability"), F.round("overall_risk_score", 6),
             F.round(F.col("risk_factors_count") / 5.0, 6)]
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("model_order"), p.cast("double").alias("probability"))
        for i, (m, p) in enumerate(zip(SCORERS, probs))]))
    t = s.select(*keys, rows.alias("r")).select(*keys, "r.*")
    return t.withColumn("prediction", sc.hard_label(F.col("probability")))


SC_SQL = """sc_ AS (
  SELECT * , CASE WHEN probability IS NULL OR isnan(probability) THEN 0
                  ELSE CAST(probability > 0.5 AS INTEGER) END AS prediction FROM (
    SELECT 'frozen_logistic' AS model, 0 AS model_order, student_id, dropout_status, fold,
           dropout_probability AS probability FROM scored JOIN split_ USING (student_id)
    UNION ALL
    SELECT 'overall_risk', 1, student_id, dropout_status, fold, round(overall_risk_score, 6)
    FROM scored JOIN split_ USING (student_id)
    UNION ALL
    SELECT 'risk_factors', 2, student_id, dropout_status, fold, round(risk_factors_count / 5.0::DOUBLE, 6)
    FROM scored JOIN split_ USING (student_id)))"""

BASE = [STUDENTS, FEATURES, SCORED, SPLIT_SQL, SC_SQL]

BIN_SQL = """bin_ AS (
  SELECT model, COUNT(*) AS n_,
    SUM(CASE WHEN dropout_status = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
    SUM(CASE WHEN dropout_status = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
    SUM(CASE WHEN dropout_status = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn,
    SUM(CASE WHEN dropout_status = prediction THEN 1 ELSE 0 END) AS ok
  FROM sc_ GROUP BY model),
binm_ AS (
  SELECT model,
    coalesce(ok::DOUBLE / nullif(n_, 0), 0) AS accuracy,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
    coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1_score
  FROM bin_)"""


def _auc_sql(keys: str) -> str:
    return f"""g_ AS (
  SELECT {keys}, probability AS p, SUM(dropout_status) AS pos, SUM(1 - dropout_status) AS neg
  FROM sc_ WHERE probability IS NOT NULL GROUP BY {keys}, probability),
c_ AS (
  SELECT *, coalesce(SUM(neg) OVER (PARTITION BY {keys} ORDER BY p
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM g_),
auc_ AS (
  SELECT {keys}, SUM(pos * (neg_below + 0.5 * neg))::DOUBLE / (SUM(pos)::DOUBLE * SUM(neg)::DOUBLE) AS roc_auc
  FROM c_ GROUP BY {keys})"""


CV_SQL = _auc_sql("model, fold").replace("g_ AS", "gf_ AS").replace("FROM g_", "FROM gf_") \
    .replace("c_ AS", "cf_ AS").replace("FROM c_", "FROM cf_").replace("auc_ AS", "aucf_ AS") + """,
cv_ AS (SELECT model, avg(roc_auc) AS cv_mean, stddev_pop(roc_auc) AS cv_std FROM aucf_ GROUP BY model)"""

COMPARISON_SQL = """cmp_ AS (
  SELECT binm_.model, accuracy, precision, recall, f1_score, roc_auc, cv_mean, cv_std
  FROM binm_ JOIN auc_ USING (model) JOIN cv_ USING (model))"""


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    t = scorer_table(spark, sf, folds=True)
    ev = mt.evaluate(t, LABEL, "probability", "prediction", ["model"])
    cv = mt.cv_scores(t, LABEL, "probability", "fold", ["model"])
    return ev.join(cv, "model").select("model", *mt.METRICS)


@query("binary_metrics", with_(*BASE, BIN_SQL, body="""
SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM binm_"""))
def q_binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, precision, recall, F1 per scorer."""
    return round_doubles(mt.binary_metrics(scorer_table(spark, sf), LABEL, "prediction", ["model"]))


@query("roc_auc", with_(*BASE, _auc_sql("model"), body="SELECT model, round(roc_auc, 6) AS roc_auc FROM auc_"))
def q_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Exact, tie-correct ROC AUC per scorer."""
    return round_doubles(mt.roc_auc(scorer_table(spark, sf), LABEL, "probability", ["model"]))


@query("cv_scores", with_(*BASE, CV_SQL, body="""
SELECT model, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std FROM cv_"""))
def q_cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population std of the per-fold AUC (stratified 5 folds)."""
    return round_doubles(mt.cv_scores(scorer_table(spark, sf, folds=True), LABEL, "probability", "fold", ["model"]))


@query("model_comparison", with_(*BASE, BIN_SQL, _auc_sql("model"), CV_SQL, COMPARISON_SQL, body="""
SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score, round(roc_auc, 6) AS roc_auc, round(cv_mean, 6) AS cv_mean,
  round(cv_std, 6) AS cv_std FROM cmp_"""))
def q_model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison table sorted by ROC AUC."""
    return round_doubles(mt.model_comparison(comparison(spark, sf)))


@query("metrics_long", with_(*BASE, BIN_SQL, _auc_sql("model"), CV_SQL, COMPARISON_SQL, body="""
SELECT model, Metric, round(Value, 6) AS Value FROM cmp_
UNPIVOT (Value FOR Metric IN (accuracy, precision, recall, f1_score, roc_auc, cv_mean, cv_std))"""))
def q_metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    """Metric dict -> (Metric, Value) rows."""
    return round_doubles(mt.metrics_long(comparison(spark, sf)))


@query("best_model", with_(*BASE, _auc_sql("model"), body="""
SELECT arg_max(model, roc_auc) AS best_model, round(max(roc_auc), 6) AS best_roc_auc FROM auc_"""))
def q_best_model(spark: SparkSession, sf: str) -> DataFrame:
    """Argmax ROC AUC, the earlier model wins ties."""
    t = scorer_table(spark, sf)
    auc = mt.roc_auc(t, LABEL, "probability", ["model", "model_order"])
    return round_doubles(mt.best_model(auc))


@query("hard_label", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT student_id, CASE WHEN dropout_probability IS NULL OR isnan(dropout_probability) THEN 0
  ELSE CAST(dropout_probability > 0.5 AS INTEGER) END AS prediction FROM scored"""))
def q_hard_label(spark: SparkSession, sf: str) -> DataFrame:
    """prediction = probability > 0.5 (NaN/NULL -> 0)."""
    s = scored_df(spark, sf)
    return s.select(ID, sc.hard_label(F.col("dropout_probability")).alias("prediction"))


@query("confusion_matrix", with_(*BASE, body="""
SELECT dropout_status AS label,
  CAST(SUM(CASE WHEN prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
  CAST(SUM(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1
FROM sc_ WHERE model = 'frozen_logistic' GROUP BY dropout_status"""))
def q_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix of the frozen scorer."""
    t = scorer_table(spark, sf).where(F.col("model") == "frozen_logistic")
    return mt.confusion_matrix(t, LABEL, "prediction")


@query("classification_report", with_(*BASE, """cr_ AS (
  SELECT COUNT(*) AS n,
    SUM(CASE WHEN dropout_status = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tp0,
    SUM(CASE WHEN dropout_status = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp1,
    SUM(CASE WHEN prediction = 0 THEN 1 ELSE 0 END) AS pp0, SUM(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS pp1,
    SUM(CASE WHEN dropout_status = 0 THEN 1 ELSE 0 END) AS s0, SUM(CASE WHEN dropout_status = 1 THEN 1 ELSE 0 END) AS s1
  FROM sc_ WHERE model = 'frozen_logistic')""", """pc_ AS (
  SELECT '0' AS class, coalesce(tp0::DOUBLE / nullif(pp0, 0), 0) AS precision,
         coalesce(tp0::DOUBLE / nullif(s0, 0), 0) AS recall, s0::DOUBLE AS support FROM cr_
  UNION ALL
  SELECT '1', coalesce(tp1::DOUBLE / nullif(pp1, 0), 0), coalesce(tp1::DOUBLE / nullif(s1, 0), 0),
         s1::DOUBLE FROM cr_)""", """pf_ AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM pc_)""",
    body="""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       round(support, 6) AS support FROM pf_
UNION ALL
SELECT 'accuracy', NULL, NULL, round(coalesce((tp0 + tp1)::DOUBLE / nullif(n, 0), 0), 6), n::DOUBLE FROM cr_
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), sum(support) FROM pf_
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1_score * support) / sum(support), 6), sum(support) FROM pf_"""))
def q_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    """E5: per-class report of the frozen scorer with accuracy and averages."""
    t = scorer_table(spark, sf).where(F.col("model") == "frozen_logistic")
    return round_doubles(mt.classification_report(t, LABEL, "prediction"))
