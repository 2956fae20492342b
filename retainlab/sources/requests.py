"""Request batches as JSON rows (S3) and JSON responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# API contract of one student record (the label is not part of a request).
STUDENT_SCHEMA = T.StructType([
    T.StructField("student_id", T.StringType()),
    T.StructField("age", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("family_income", T.StringType()),
    T.StructField("parent_education", T.StringType()),
    T.StructField("family_size", T.LongType()),
    T.StructField("rural_urban", T.StringType()),
    T.StructField("first_generation", T.IntegerType()),
    T.StructField("previous_grades", T.DoubleType()),
    T.StructField("attendance_rate", T.DoubleType()),
    T.StructField("extracurricular_activities", T.LongType()),
    T.StructField("study_hours_per_week", T.LongType()),
    T.StructField("subject_preferences", T.StringType()),
    T.StructField("learning_disability", T.IntegerType()),
    T.StructField("special_education_needs", T.IntegerType()),
    T.StructField("scholarship_received", T.IntegerType()),
    T.StructField("scholarship_amount", T.DoubleType()),
    T.StructField("financial_aid", T.IntegerType()),
    T.StructField("work_study_program", T.IntegerType()),
    T.StructField("part_time_job", T.IntegerType()),
    T.StructField("family_financial_support", T.StringType()),
    T.StructField("debt_amount", T.DoubleType()),
    T.StructField("interview_score", T.DoubleType()),
    T.StructField("motivation_level", T.StringType()),
    T.StructField("career_goals_clarity", T.LongType()),
    T.StructField("emotional_stability", T.LongType()),
    T.StructField("peer_relationships", T.StringType()),
    T.StructField("teacher_relationships", T.StringType()),
    T.StructField("disciplinary_issues", T.LongType()),
])
REQUEST_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("students", T.ArrayType(STUDENT_SCHEMA)),
])
SCORE_SCHEMA = T.StructType([
    T.StructField("student_id", T.StringType()),
    T.StructField("dropout_probability", T.DoubleType()),
    T.StructField("retention_score", T.DoubleType()),
    T.StructField("risk_category", T.StringType()),
    T.StructField("recommendations", T.StructType([
        T.StructField("priority", T.StringType()),
        T.StructField("actions", T.ArrayType(T.StringType())),
        T.StructField("frequency", T.StringType()),
    ])),
])


def malformed_requests(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """The bodies that ``request_rows`` gives no row for: not JSON, or without a list of students."""
    parsed = F.from_json(F.col(body_col), REQUEST_SCHEMA)
    return bodies.where(F.coalesce(F.size(parsed["students"]), F.lit(-1)) < 1)


def request_rows(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """S3: JSON request bodies -> one row per student (plus the batch id)."""
    parsed = bodies.select(F.from_json(F.col(body_col), REQUEST_SCHEMA).alias("r"))
    return parsed.select(F.col("r.batch_id").alias("batch_id"),
                         F.explode("r.students").alias("s")).select("batch_id", "s.*")


def build_requests(students: DataFrame, batch_key: Column) -> DataFrame:
    """Group student rows into JSON request bodies, one per ``batch_key``.

    The caller's key decides the batch size; ``collect_list`` runs per batch,
    so the key must bound the group (e.g. ``id div 100``), never a constant.
    """
    rec = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STUDENT_SCHEMA.fields])
    grouped = students.groupBy(batch_key.cast("string").alias("batch_id")).agg(
        F.collect_list(rec).alias("students"))
    return grouped.select(F.to_json(F.struct("batch_id", "students")).alias("body"))


def response_json(scored: DataFrame) -> DataFrame:
    """One JSON document per scored row (nested recommendation kept)."""
    cols = [c for c in ("student_id", "dropout_probability", "retention_score", "risk_category",
                        "recommendations") if c in scored.columns]
    return scored.select(F.to_json(F.struct(*cols)).alias("json"))


def parse_responses(docs: DataFrame, col: str = "json") -> DataFrame:
    return docs.select(F.from_json(F.col(col), SCORE_SCHEMA).alias("r")).select("r.*")
