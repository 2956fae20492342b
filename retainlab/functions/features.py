"""Derived student features (F1-F23) as column expressions.

Each group is one ``select`` so Catalyst collapses the five groups into a
single projection inside whole-stage codegen.  The only dataset-level value,
the maximum financial burden (F20, F23), is a scalar subquery: Spark runs it
as one partial+final aggregate and inlines the result as a literal, so no
join and no unpartitioned window is involved.  For streams and for scoring
new requests, pass ``max_burden`` (the value frozen at fit time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.functions.cut import cut, flag, lookup

# Fixed values that must equal the reference's (bins, labels, mappings, weights).
GRADE_EDGES = [0, 60, 75, 90, 100]
GRADE_LABELS = ["Poor", "Average", "Good", "Excellent"]
SUPPORT_EDGES = [-1, 0, 5000, 10000, 20000]
SUPPORT_LABELS = ["No Support", "Low", "Medium", "High"]
INCOME_MAP = {"Low": 1, "Medium": 2, "High": 3}
MOTIVATION_MAP = {"Low": 1, "Medium": 2, "High": 3}
RELATION_MAP = {"Poor": 1, "Average": 2, "Good": 3}
EDUCATION_MAP = {"Primary": 1, "Secondary": 2, "Graduate": 3, "Postgraduate": 4}
AID_AMOUNT = 5000
BURDEN_UNIT = 10000

ACADEMIC = ["academic_performance_category", "attendance_category", "study_efficiency",
            "academic_engagement"]
FINANCIAL = ["total_financial_support", "family_income_numeric", "financial_burden",
             "financial_stability", "financial_need_level"]
PERSONAL = ["motivation_score", "peer_relationship_score", "teacher_relationship_score",
            "social_score", "personal_stability", "risk_factors_count"]
DEMOGRAPHIC = ["parent_education_level", "family_responsibility", "socioeconomic_status",
               "location_disadvantage"]
INTERACTION = ["academic_financial_balance", "personal_academic_fit",
               "social_financial_support", "overall_risk_score"]
ENGINEERED = ACADEMIC + FINANCIAL + PERSONAL + DEMOGRAPHIC + INTERACTION

c = F.col


def academic_features(df: DataFrame) -> DataFrame:
    hours = c("study_hours_per_week")
    return df.select(
        "*",
        cut(c("previous_grades"), GRADE_EDGES, GRADE_LABELS).alias("academic_performance_category"),
        cut(c("attendance_rate"), GRADE_EDGES, GRADE_LABELS).alias("attendance_category"),
        (c("previous_grades") / F.when(hours == 0, F.lit(1)).otherwise(hours)).alias("study_efficiency"),
        ((c("attendance_rate") / 100) * 0.7 + (c("extracurricular_activities") / 5) * 0.3)
        .alias("academic_engagement"),
    )


def financial_features(df: DataFrame) -> DataFrame:
    support = c("scholarship_amount") + c("financial_aid") * AID_AMOUNT
    income = lookup(c("family_income"), INCOME_MAP)
    return df.select(
        "*",
        support.alias("total_financial_support"),
        income.alias("family_income_numeric"),
        F.try_divide(c("debt_amount"), income * BURDEN_UNIT).alias("financial_burden"),
        (c("scholarship_received") * 0.4 + c("financial_aid") * 0.3
         + (1 - c("work_study_program") * 0.2) + (1 - c("part_time_job") * 0.1))
        .alias("financial_stability"),
        cut(support, SUPPORT_EDGES, SUPPORT_LABELS).alias("financial_need_level"),
    )


def personal_features(df: DataFrame) -> DataFrame:
    motivation = lookup(c("motivation_level"), MOTIVATION_MAP)
    peer = lookup(c("peer_relationships"), RELATION_MAP)
    teacher = lookup(c("teacher_relationships"), RELATION_MAP)
    return df.select(
        "*",
        motivation.alias("motivation_score"),
        peer.alias("peer_relationship_score"),
        teacher.alias("teacher_relationship_score"),
        (peer * 0.5 + teacher * 0.5).alias("social_score"),
        ((c("emotional_stability") / 10) * 0.4 + (motivation / 3) * 0.3
         + (c("career_goals_clarity") / 10) * 0.3).alias("personal_stability"),
        (flag(c("learning_disability") == 1) + flag(c("special_education_needs") == 1)
         + flag(c("disciplinary_issues") > 3) + flag(c("emotional_stability") < 5)
         + flag(c("motivation_level") == "Low")).alias("risk_factors_count"),
    )


def demographic_features(df: DataFrame) -> DataFrame:
    edu = lookup(c("parent_education"), EDUCATION_MAP)
    income = c("family_income_numeric") if "family_income_numeric" in df.columns \
        else lookup(c("family_income"), INCOME_MAP)
    out = [
        edu.alias("parent_education_level"),
        (F.try_divide(F.lit(1), c("family_size")) * (1 + c("first_generation") * 0.5))
        .alias("family_responsibility"),
        (income * 0.6 + edu * 0.4).alias("socioeconomic_status"),
        (flag(c("rural_urban") == "Rural") * flag(c("family_income") == "Low"))
        .alias("location_disadvantage"),
    ]
    if "family_income_numeric" not in df.columns:
        out.insert(0, income.alias("family_income_numeric"))
    return df.select("*", *out)


def burden_max(df: DataFrame) -> Column:
    """Dataset maximum of ``financial_burden`` as a scalar subquery column."""
    return df.select(F.max("financial_burden")).scalar()


def interaction_features(df: DataFrame, max_burden: float | Column | None = None) -> DataFrame:
    """F20-F23.  ``max_burden=None`` -> batch maximum (reference behaviour)."""
    mx = burden_max(df) if max_burden is None else (
        max_burden if isinstance(max_burden, Column) else F.lit(float(max_burden)))
    ratio = F.try_divide(c("financial_burden"), mx)
    return df.select(
        "*",
        ((c("previous_grades") / 100) * (1 - ratio)).alias("academic_financial_balance"),
        (c("personal_stability") * c("academic_engagement")).alias("personal_academic_fit"),
        (c("social_score") * (1 + c("total_financial_support") / 10000)).alias("social_financial_support"),
        ((1 - c("academic_engagement")) * 0.3 + ratio * 0.3 + (1 - c("personal_stability")) * 0.2
         + (3 - c("social_score")) / 3 * 0.2).alias("overall_risk_score"),
    )


def engineer_features(df: DataFrame, max_burden: float | Column | None = None) -> DataFrame:
    """All 23 derived columns: academic -> financial -> personal -> demographic -> interaction."""
    out = demographic_features(personal_features(financial_features(academic_features(df))))
    return interaction_features(out, max_burden)


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns a transform added, in output order."""
    seen = set(before.columns)
    return [x for x in after.columns if x not in seen]
