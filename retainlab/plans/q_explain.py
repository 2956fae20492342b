"""Registered queries: explanations (H1, H3-H5, H9-H11, H13) and exploration (V1, V2, V4).

The oracle-checked explanations use the frozen logistic scorer, whose margin
``2 + 2 * burden_ratio - 4 * academic_engagement`` is linear, so its SHAP
values have the exact closed form; the background is the whole
training split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.functions.features import burden_max
from retainlab.operators import contract as ct
from retainlab.operators import explain as ex
from retainlab.operators import explore as eo
from retainlab.operators import split as sp
from retainlab.plans.oracle import FEATURES, STUDENTS, with_
from retainlab.plans.q_prep import SPLIT_SQL
from retainlab.plans.q_scoring import features_df
from retainlab.plans.registry import query, round_doubles
from retainlab.session import once
from retainlab.sources.fixture import ID, LABEL, students

WEIGHTS = {"burden_ratio": 2.0, "academic_engagement": -4.0}
INTERCEPT = 2.0


def explain_inputs(spark: SparkSession, sf: str) -> DataFrame:
    # split, maximum, means and rows all read these four columns: derive them once
    f = sp.stratified_split(once(features_df(spark, sf).select(ID, LABEL, "financial_burden", "academic_engagement")))
    return once(f.select(ID, "split", F.try_divide(F.col("financial_burden"), burden_max(f)).alias("burden_ratio"),
                         "academic_engagement"))


def shap_table(spark: SparkSession, sf: str) -> DataFrame:
    x = explain_inputs(spark, sf)
    return ex.linear_shap(x, x.where("split = 'train'"), WEIGHTS)


EX_SQL = [STUDENTS, FEATURES, SPLIT_SQL, """ex_ AS (
  SELECT features.student_id, split_.split, financial_burden / NULLIF(bmax_.mx, 0) AS burden_ratio, academic_engagement
  FROM features JOIN split_ ON split_.student_id = features.student_id, bmax_)""", """bgm_ AS (
  SELECT avg(burden_ratio) AS m1, avg(academic_engagement) AS m2
  FROM ex_ WHERE split = 'train')""", """shap_ AS (
  SELECT student_id, 'burden_ratio' AS feature, burden_ratio AS value,
         2.0::DOUBLE * (burden_ratio - m1) AS contribution FROM ex_, bgm_
  UNION ALL
  SELECT student_id, 'academic_engagement', academic_engagement,
         -4.0::DOUBLE * (academic_engagement - m2) FROM ex_, bgm_)"""]


@query("shap_linear", with_(*EX_SQL, body="""
SELECT student_id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM shap_"""))
def q_shap_linear(spark: SparkSession, sf: str) -> DataFrame:
    """H1/H9: exact SHAP values of the linear scorer, long form (summary-plot data)."""
    return round_doubles(shap_table(spark, sf))


@query("shap_base", with_(*EX_SQL, body="""
SELECT round(avg(2.0::DOUBLE + 2 * burden_ratio - 4 * academic_engagement), 6) AS expected_value
FROM ex_ WHERE split = 'train'"""))
def q_shap_base(spark: SparkSession, sf: str) -> DataFrame:
    """H3: expected value = mean margin over the background."""
    x = explain_inputs(spark, sf)
    margin = F.lit(INTERCEPT) + 2 * F.col("burden_ratio") - 4 * F.col("academic_engagement")
    return round_doubles(ex.base_value(x.where("split = 'train'"), margin))


@query("shap_importance", with_(*EX_SQL, body="""
SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM shap_ GROUP BY feature"""))
def q_shap_importance(spark: SparkSession, sf: str) -> DataFrame:
    """H4: global importance = mean |SHAP|, top 20."""
    return round_doubles(ex.global_importance(shap_table(spark, sf), 20))


@query("importance_ordered", with_(*EX_SQL, body="""
SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM shap_ GROUP BY feature"""))
def q_importance_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """V4: importance bars ordered by total."""
    return round_doubles(ex.importance_ordered(ex.global_importance(shap_table(spark, sf), 20)))


@query("shap_local", with_(*EX_SQL, body="""
SELECT student_id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution,
  CAST(row_number() OVER (PARTITION BY student_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank
FROM shap_"""))
def q_shap_local(spark: SparkSession, sf: str) -> DataFrame:
    """Per student the features ranked by |SHAP| (top 10)."""
    return round_doubles(ex.local_explanation(shap_table(spark, sf), 10))


@query("shap_positions", with_(*EX_SQL, """pos_ AS (
  SELECT student_id FROM (
    SELECT student_id, row_number() OVER (ORDER BY student_id) - 1 AS position, COUNT(*) OVER () AS n FROM ex_)
  WHERE position IN (0, n // 4, n // 2, 3 * n // 4, n - 1))""", body="""
SELECT student_id, feature, round(contribution, 6) AS contribution,
  CAST(row_number() OVER (PARTITION BY student_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank
FROM shap_ JOIN pos_ USING (student_id)"""))
def q_shap_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Local explanations of the five report positions (ids joined, not collected)."""
    x = explain_inputs(spark, sf)
    s = ex.linear_shap(x, x.where("split = 'train'"), WEIGHTS)
    pos = ct.sample_positions(x.select(ID)).select(ID)
    loc = ex.local_explanation(s.join(pos, ID), 10)
    return round_doubles(loc.select(ID, "feature", "contribution", "rank"))


@query("shap_dependence", with_(*EX_SQL, body="""
SELECT round(value, 6) AS value, round(contribution, 6) AS contribution FROM shap_
WHERE feature = 'academic_engagement'"""))
def q_shap_dependence(spark: SparkSession, sf: str) -> DataFrame:
    """Dependence-plot data of one feature."""
    return round_doubles(ex.dependence(shap_table(spark, sf), "academic_engagement"))


# ------------------------------------------------------------------ exploration

CORR_COLS = ["age", "family_size", "previous_grades", "attendance_rate", "extracurricular_activities",
             "study_hours_per_week", "scholarship_amount", "debt_amount", "interview_score",
             "career_goals_clarity", "emotional_stability", "disciplinary_issues", "dropout_status",
             "first_generation", "learning_disability", "special_education_needs", "scholarship_received",
             "financial_aid", "work_study_program", "part_time_job"]


@query("histogram", with_(STUDENTS, """mm_ AS (SELECT min(attendance_rate) AS lo, max(attendance_rate) AS hi FROM students)""",
                          """w_ AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0::DOUBLE END AS width FROM mm_)""",
                          body="""
SELECT CAST(least(floor((attendance_rate - lo) / width), 19) AS INTEGER) AS bin,
  round(lo + CAST(least(floor((attendance_rate - lo) / width), 19) AS INTEGER) * width, 6) AS bin_start,
  round(lo + (CAST(least(floor((attendance_rate - lo) / width), 19) AS INTEGER) + 1) * width, 6) AS bin_end,
  COUNT(*) AS count
FROM students, w_ WHERE attendance_rate IS NOT NULL GROUP BY ALL"""))
def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """V1: 20-bin histogram of the attendance rate."""
    return round_doubles(eo.histogram(students(spark, sf), "attendance_rate", 20))


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i:]:
            r = f"CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN round(corr({a}, {b}), 6) END"
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r} AS correlation FROM students")
            if a != b:
                parts.append(f"SELECT '{b}', '{a}', {r} FROM students")
    return with_(STUDENTS, body="\nUNION ALL\n".join(parts))


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """V2: Pearson correlation matrix of the numeric columns, long form."""
    return round_doubles(eo.correlation_matrix(students(spark, sf), CORR_COLS))
