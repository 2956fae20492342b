"""Registered queries: features, label rule, scoring, tiers, recommendations, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.functions import features as fx
from retainlab.functions.cut import clip, zero_padded_id
from retainlab.functions.label import dropout_points, rule_label
from retainlab.operators import scoring as sc
from retainlab.plans.oracle import FEATURES, SCORED, STUDENTS, d, with_
from retainlab.plans.registry import query, round_doubles
from retainlab.session import once
from retainlab.sources.fixture import memo_plan, students


def features_df(spark: SparkSession, sf: str) -> DataFrame:
    return memo_plan(spark, ("features", sf), lambda: fx.engineer_features(students(spark, sf)))


def scored_df(spark: SparkSession, sf: str, keep: list[str] | None = None) -> DataFrame:
    """Student features scored with the frozen logistic scorer (R3 + kept columns)."""
    def build():
        f = features_df(spark, sf)
        p = sc.frozen_probability(f)
        return sc.score_frame(f.withColumn("_p", p), "_p", keep=keep)
    return memo_plan(spark, ("scored", sf, tuple(keep or ())), build)


def _feat_sql(cols: list[str]) -> str:
    sel = ", ".join(
        f"round({c}, 6) AS {c}" if c in _DOUBLE_FEATS else c for c in cols)
    return with_(STUDENTS, FEATURES, body=f"SELECT student_id, {sel} FROM features")


_DOUBLE_FEATS = {"study_efficiency", "academic_engagement", "total_financial_support",
                 "financial_burden", "financial_stability", "social_score", "personal_stability",
                 "family_responsibility", "socioeconomic_status", "academic_financial_balance",
                 "personal_academic_fit", "social_financial_support", "overall_risk_score"}


def _feat_query(name: str, cols: list[str]):
    @query(name, _feat_sql(cols))
    def _q(spark: SparkSession, sf: str) -> DataFrame:
        return round_doubles(features_df(spark, sf).select("student_id", *cols))
    return _q


feat_academic = _feat_query("feat_academic", fx.ACADEMIC)
feat_financial = _feat_query("feat_financial", fx.FINANCIAL)
feat_personal = _feat_query("feat_personal", fx.PERSONAL)
feat_demographic = _feat_query("feat_demographic", fx.DEMOGRAPHIC)
feat_interaction = _feat_query("feat_interaction", fx.INTERACTION)
feat_all = _feat_query("feat_all", fx.ENGINEERED)


@query("rule_label", with_(STUDENTS, body="""
SELECT student_id, dropout_status,
  CAST(CASE WHEN previous_grades < 60 THEN 15 ELSE 0 END + CASE WHEN attendance_rate < 70 THEN 15 ELSE 0 END
   + CASE WHEN family_income = 'Low' THEN 10 ELSE 0 END + CASE WHEN scholarship_received = 0 THEN 10 ELSE 0 END
   + CASE WHEN financial_aid = 0 THEN 10 ELSE 0 END + CASE WHEN motivation_level = 'Low' THEN 10 ELSE 0 END
   + CASE WHEN career_goals_clarity < 5 THEN 10 ELSE 0 END + CASE WHEN emotional_stability < 5 THEN 5 ELSE 0 END
   + CASE WHEN peer_relationships = 'Poor' THEN 5 ELSE 0 END + CASE WHEN teacher_relationships = 'Poor' THEN 5 ELSE 0 END
   + CASE WHEN disciplinary_issues > 5 THEN 5 ELSE 0 END AS INTEGER) AS points,
  CAST(CASE WHEN previous_grades < 60 THEN 15 ELSE 0 END + CASE WHEN attendance_rate < 70 THEN 15 ELSE 0 END
   + CASE WHEN family_income = 'Low' THEN 10 ELSE 0 END + CASE WHEN scholarship_received = 0 THEN 10 ELSE 0 END
   + CASE WHEN financial_aid = 0 THEN 10 ELSE 0 END + CASE WHEN motivation_level = 'Low' THEN 10 ELSE 0 END
   + CASE WHEN career_goals_clarity < 5 THEN 10 ELSE 0 END + CASE WHEN emotional_stability < 5 THEN 5 ELSE 0 END
   + CASE WHEN peer_relationships = 'Poor' THEN 5 ELSE 0 END + CASE WHEN teacher_relationships = 'Poor' THEN 5 ELSE 0 END
   + CASE WHEN disciplinary_issues > 5 THEN 5 ELSE 0 END > 50 AS INTEGER) AS rule_only_label
FROM students"""))
def q_rule_label(spark: SparkSession, sf: str) -> DataFrame:
    """integer points of the dropout rule, the noisy label, and the noise-free label."""
    s = students(spark, sf)
    pts = dropout_points()
    return s.select("student_id", "dropout_status", pts.cast("int").alias("points"),
                    rule_label(pts).alias("rule_only_label"))


@query("scalar_misc", with_(STUDENTS, body=f"""
SELECT student_id,
  least(greatest(interview_score * 2 - 5, {d(0)}), {d(10)}) AS interview_clipped,
  least(greatest(attendance_rate, {d(30)}), {d(100)}) AS attendance_clipped,
  CASE WHEN scholarship_received = 1 THEN scholarship_amount ELSE {d(0)} END AS scholarship_if_received,
  printf('STU_%05d', CAST(substr(student_id, 5) AS BIGINT) % 100000) AS short_id
FROM students"""))
def q_scalar_misc(spark: SparkSession, sf: str) -> DataFrame:
    """F24 clip, F25 if/else column, F27 zero-padded id."""
    s = students(spark, sf)
    num = F.substring("student_id", 5, 100).cast("bigint")
    return round_doubles(s.select(
        "student_id",
        clip(F.col("interview_score") * 2 - 5, 0.0, 10.0).alias("interview_clipped"),
        clip(F.col("attendance_rate"), 30.0, 100.0).alias("attendance_clipped"),
        F.when(F.col("scholarship_received") == 1, F.col("scholarship_amount"))
        .otherwise(F.lit(0.0)).alias("scholarship_if_received"),
        zero_padded_id("STU_", num % 100000, 5).alias("short_id")))


SCORE_SQL = with_(STUDENTS, FEATURES, SCORED, body="""
SELECT student_id, round(dropout_probability, 6) AS dropout_probability,
       round(retention_score, 6) AS retention_score, risk_category FROM scored""")


@query("score_frame", SCORE_SQL)
def q_score_frame(spark: SparkSession, sf: str) -> DataFrame:
    """R3 (M13 with the frozen scorer): id, probability, score, tier."""
    return round_doubles(scored_df(spark, sf))


@query("retention_score", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT student_id, round(retention_score, 6) AS retention_score,
       round(retention_score + 100 * dropout_probability, 6) AS check_total FROM scored"""))
def q_retention_score(spark: SparkSession, sf: str) -> DataFrame:
    """R1 and its identity score + 100 p = 100."""
    s = scored_df(spark, sf)
    return round_doubles(s.select("student_id", "retention_score",
                                  (F.col("retention_score") + 100 * F.col("dropout_probability"))
                                  .alias("check_total")))


@query("risk_tier", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT risk_category, COUNT(*) AS n, CAST(SUM(dropout_status) AS BIGINT) AS positives
FROM scored GROUP BY risk_category"""))
def q_risk_tier(spark: SparkSession, sf: str) -> DataFrame:
    """R2: tiers with their size and label count."""
    s = scored_df(spark, sf, keep=["dropout_status"])
    return s.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"),
                                          F.sum("dropout_status").cast("bigint").alias("positives"))


def _actions_sql(tier_expr: str = "risk_category", rules: bool = True) -> str:
    def arr(base, extra):
        parts = [f"'{a}'" for a in base]
        if rules:
            parts += [f"CASE WHEN {c} THEN '{a}' END" for c, a in extra]
        return "concat_ws('|', " + ", ".join(parts) + ")"
    med = arr(sc.MEDIUM_ACTIONS, [("attendance_rate < 75", sc.MEDIUM_RULES[0][3]),
                                  ("previous_grades < 60", sc.MEDIUM_RULES[1][3]),
                                  ("family_income = 'Low'", sc.MEDIUM_RULES[2][3])])
    high = arr(sc.HIGH_ACTIONS, [("attendance_rate < 60", sc.HIGH_RULES[0][3]),
                                 ("previous_grades < 50", sc.HIGH_RULES[1][3]),
                                 ("family_income = 'Low'", sc.HIGH_RULES[2][3]),
                                 ("emotional_stability < 5", sc.HIGH_RULES[3][3])])
    low = arr(sc.LOW_ACTIONS, [])
    t = tier_expr
    return f"""
  CASE WHEN {t} = '{sc.LOW}' THEN 'Low' WHEN {t} = '{sc.MEDIUM}' THEN 'Medium' ELSE 'High' END AS priority,
  CASE WHEN {t} = '{sc.LOW}' THEN {low} WHEN {t} = '{sc.MEDIUM}' THEN {med} ELSE {high} END AS actions,
  CASE WHEN {t} = '{sc.LOW}' THEN 'Monthly check-ins' WHEN {t} = '{sc.MEDIUM}' THEN 'Bi-weekly check-ins'
       ELSE 'Weekly check-ins' END AS frequency"""


def _flat_rec(df: DataFrame) -> DataFrame:
    return df.select("student_id", F.col("recommendations.priority").alias("priority"),
                     F.array_join("recommendations.actions", "|").alias("actions"),
                     F.col("recommendations.frequency").alias("frequency"))


REC_KEEP = ["attendance_rate", "previous_grades", "family_income", "emotional_stability"]


@query("recommendations", with_(STUDENTS, FEATURES, SCORED, body=f"""
SELECT student_id, {_actions_sql()} FROM scored"""))
def q_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendation struct per student (flattened for comparison)."""
    s = scored_df(spark, sf, keep=REC_KEEP)
    return _flat_rec(sc.with_recommendations(s))


@query("recommendations_base", with_(STUDENTS, FEATURES, SCORED, body=f"""
SELECT student_id, {_actions_sql(rules=False)} FROM scored"""))
def q_recommendations_base(spark: SparkSession, sf: str) -> DataFrame:
    """Over the bare score frame only the base actions apply."""
    return _flat_rec(sc.with_recommendations(scored_df(spark, sf)))


@query("score_with_actions", with_(STUDENTS, FEATURES, SCORED, body=f"""
SELECT student_id, round(dropout_probability, 6) AS dropout_probability,
       round(retention_score, 6) AS retention_score, risk_category, {_actions_sql()} FROM scored"""))
def q_score_with_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows joined to their recommendation (first match per id)."""
    s = once(scored_df(spark, sf, keep=REC_KEEP))  # both sides of the join
    recs = sc.with_recommendations(s).select("student_id", "recommendations")
    out = sc.score_with_actions(s.select("student_id", "dropout_probability", "retention_score",
                                         "risk_category"), recs)
    return round_doubles(out.select(
        "student_id", "dropout_probability", "retention_score", "risk_category",
        F.col("recommendations.priority").alias("priority"),
        F.array_join("recommendations.actions", "|").alias("actions"),
        F.col("recommendations.frequency").alias("frequency")))


@query("score_summary", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT COUNT(*) AS total_students, round(avg(retention_score), 6) AS average_retention_score,
       round(median(retention_score), 6) AS median_retention_score,
       round(min(retention_score), 6) AS min_retention_score,
       round(max(retention_score), 6) AS max_retention_score FROM scored"""))
def q_score_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A1: size, mean, exact median, min and max of the retention score."""
    return round_doubles(sc.score_summary(once(scored_df(spark, sf))))


@query("risk_distribution", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT risk_category, COUNT(*) AS count FROM scored GROUP BY risk_category"""))
def q_risk_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """A2: tier counts, descending."""
    return sc.risk_distribution(scored_df(spark, sf))


@query("risk_percentage", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT risk_category, round(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM scored), 2) AS percentage
FROM scored GROUP BY risk_category"""))
def q_risk_percentage(spark: SparkSession, sf: str) -> DataFrame:
    """A3: tier share x100, 2 places."""
    return sc.risk_percentage(scored_df(spark, sf))


def _stats_sql(batch: str | None) -> str:
    key = f"{batch} AS batch_id, " if batch else ""
    grp = f"GROUP BY {batch}" if batch else ""
    cnt = lambda t: f"CAST(SUM(CASE WHEN risk_category = '{t}' THEN 1 ELSE 0 END) AS BIGINT)"
    pct = lambda t: f"round({cnt(t)} * 100.0::DOUBLE / COUNT(*), 2)"
    return with_(STUDENTS, FEATURES, SCORED, body=f"""
SELECT {key}COUNT(*) AS total_students, round(avg(retention_score), 6) AS average_retention_score,
  {cnt(sc.LOW)} AS n_low, {cnt(sc.MEDIUM)} AS n_medium, {cnt(sc.HIGH)} AS n_high,
  {pct(sc.LOW)} AS pct_low, {pct(sc.MEDIUM)} AS pct_medium, {pct(sc.HIGH)} AS pct_high
FROM scored {grp}""")


def _flat_stats(st: DataFrame, keys: list[str]) -> DataFrame:
    get = lambda m, t: F.coalesce(F.col(m)[t], F.lit(0))
    return round_doubles(st.select(
        *keys, "total_students", "average_retention_score",
        get("risk_distribution", sc.LOW).cast("bigint").alias("n_low"),
        get("risk_distribution", sc.MEDIUM).cast("bigint").alias("n_medium"),
        get("risk_distribution", sc.HIGH).cast("bigint").alias("n_high"),
        get("risk_percentage", sc.LOW).cast("double").alias("pct_low"),
        get("risk_percentage", sc.MEDIUM).cast("double").alias("pct_medium"),
        get("risk_percentage", sc.HIGH).cast("double").alias("pct_high")))


@query("batch_stats", _stats_sql(None))
def q_batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A4: /batch-stats over the whole cohort (maps flattened for comparison)."""
    return _flat_stats(sc.batch_stats(scored_df(spark, sf)), [])


@query("batch_stats_by_gender", _stats_sql("gender"))
def q_batch_stats_by_gender(spark: SparkSession, sf: str) -> DataFrame:
    """A4 keyed by a batch column (here ``gender`` stands in for a request batch id)."""
    s = scored_df(spark, sf, keep=["gender"]).withColumnRenamed("gender", "batch_id")
    return _flat_stats(sc.batch_stats(s, "batch_id"), ["batch_id"])


@query("label_rate", with_(STUDENTS, body="""
SELECT round(avg(CAST(dropout_status AS DOUBLE)) * 100, 6) AS dropout_rate FROM students"""))
def q_label_rate(spark: SparkSession, sf: str) -> DataFrame:
    """A5: dropout share x100."""
    return round_doubles(sc.label_rate(students(spark, sf)))


@query("tier_band", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT student_id,
  CASE WHEN retention_score < 50 THEN '0-50' WHEN retention_score < 80 THEN '50-80' ELSE '80-100' END AS band,
  round(retention_score - 50, 6) AS delta_vs_50,
  CAST(retention_score >= 90 AS INTEGER) AS above_threshold,
  CASE WHEN contains(risk_category, 'Low risk') THEN 'risk-low'
       WHEN contains(risk_category, 'Medium risk') THEN 'risk-medium' ELSE 'risk-high' END AS css_class,
  round(dropout_probability * 100, 1) AS dropout_pct_display,
  round(retention_score, 1) AS retention_display
FROM scored"""))
def q_tier_band(spark: SparkSession, sf: str) -> DataFrame:
    """A6 gauge data and P12 substring predicate on the tier label."""
    s = scored_df(spark, sf)
    band = sc.tier_band(F.col("retention_score"))
    return round_doubles(s.select(
        "student_id", *[v.alias(k) for k, v in band.items()],
        F.round(F.col("dropout_probability") * 100, 1).alias("dropout_pct_display"),
        F.round("retention_score", 1).alias("retention_display")))
