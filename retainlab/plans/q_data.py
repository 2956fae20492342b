"""Registered queries: scans, sinks, stage union/merge, request rows, contract, profiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.functions import features as fx
from retainlab.operators import contract as ct
from retainlab.operators import scoring as sc
from retainlab.plans.oracle import COL_SQL, FEATURES, SCORED, STUDENTS, with_
from retainlab.plans.q_scoring import REC_KEEP, _actions_sql, scored_df
from retainlab.plans.registry import query, round_doubles
from retainlab.session import shared_path
from retainlab.sources import files, requests
from retainlab.sources.fixture import ID, LABEL, STAGE_COLUMNS, STUDENT_COLUMNS, stage_tables, students

# ------------------------------------------------------------------ SQL twins

_STAGE_SRC = {"stage1": "oc_", "stage2": "lines_", "stage3": "oc_", "stage4": "students"}


def _stage_sql(stage: str) -> str:
    cols = STAGE_COLUMNS[stage]
    if stage == "stage4":
        sel = ", ".join(["student_id", *cols])
    else:
        sel = ", ".join([f"{COL_SQL[ID]} AS student_id", *[f"{COL_SQL[c]} AS {c}" for c in cols]])
    return f"SELECT {sel}, '{stage}' AS verification_stage FROM {_STAGE_SRC[stage]}"


STAGE_UNION = "stage_union_ AS (" + "\nUNION ALL BY NAME\n".join(
    _stage_sql(s) for s in STAGE_COLUMNS) + ")"
STAGE_UNION_SQL = with_(STUDENTS, STAGE_UNION, body="SELECT * FROM stage_union_")


def _tag(sf: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", sf.strip("/"))


def _union(spark: SparkSession, sf: str) -> DataFrame:
    return files.tag_stages(stage_tables(spark, sf))


# ------------------------------------------------------------------ sources


@query("scan_profile", with_(STUDENTS, body="SELECT * FROM students"))
def q_scan_profile(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S4: student table written as header CSV to the shared folder, scanned back
    with an explicit schema."""
    s = students(spark, sf)
    path = shared_path(spark, f"csv/students_{_tag(sf)}")
    files.write_csv(s, path)
    return files.read_csv(spark, path, s.schema)


@query("stage_load", STAGE_UNION_SQL)
def q_stage_load(spark: SparkSession, sf: str) -> DataFrame:
    """Four stage CSV files (+ one missing path, skipped) loaded and tagged."""
    stages = stage_tables(spark, sf)
    paths, schemas = {}, {}
    for name, df in stages.items():
        p = shared_path(spark, f"csv/{name}_{_tag(sf)}")
        files.write_csv(df, p)
        paths[name], schemas[name] = p, df.schema
    paths["stage5"] = shared_path(spark, f"csv/missing_stage_{_tag(sf)}")
    return files.load_stages(spark, paths, schemas)


@query("stage_union", STAGE_UNION_SQL)
def q_stage_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union-all by name of the four stages; absent columns are NULL."""
    return _union(spark, sf)


@query("stage_merge", with_(STUDENTS, body="SELECT * FROM students"))
def q_stage_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Inner equi-join of the four stages on ``student_id``.

    All four inputs are hash-partitioned on the same key, so the three joins
    share one exchange per side (no re-shuffle between joins).
    """
    st = stage_tables(spark, sf)
    m = st["stage1"].join(st["stage2"], ID).join(st["stage3"], ID).join(st["stage4"], ID)
    return m.select(*STUDENT_COLUMNS)


_BATCH_SQL = "CAST(CAST(substr(student_id, 5) AS BIGINT) // 100 AS VARCHAR)"
def _batch():
    return F.expr("cast(cast(substr(student_id, 5) as bigint) div 100 as string)")


@query("request_rows", with_(STUDENTS, body=f"""
SELECT {_BATCH_SQL} AS batch_id, * EXCLUDE (dropout_status) FROM students"""))
def q_request_rows(spark: SparkSession, sf: str) -> DataFrame:
    """S3: students grouped into JSON request bodies (<= 100 per batch by key),
    then parsed back to rows with ``from_json`` + ``explode``."""
    bodies = requests.build_requests(students(spark, sf), _batch())
    return requests.request_rows(bodies)


@query("response_json", with_(STUDENTS, FEATURES, SCORED, body=f"""
SELECT student_id, round(dropout_probability, 6) AS dropout_probability,
       round(retention_score, 6) AS retention_score, risk_category, {_actions_sql()} FROM scored"""))
def q_response_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON response documents with the nested recommendation, parsed back to
    fields for comparison (text formatting differs between engines)."""
    s = sc.with_recommendations(scored_df(spark, sf, keep=REC_KEEP))
    docs = requests.response_json(s)
    r = requests.parse_responses(docs)
    return round_doubles(r.select(
        ID, "dropout_probability", "retention_score", "risk_category",
        F.col("recommendations.priority").alias("priority"),
        F.array_join("recommendations.actions", "|").alias("actions"),
        F.col("recommendations.frequency").alias("frequency")))


# ---------------------------------------------------------- projections


@query("feature_columns", with_(STUDENTS, body="SELECT * EXCLUDE (student_id, dropout_status) FROM students"))
def q_feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Drop target and id, keep the trained feature order."""
    s = students(spark, sf).drop(LABEL, ID)
    return s.select(*[c for c in STUDENT_COLUMNS if c in s.columns])


@query("dedup", with_(STUDENTS, body="SELECT DISTINCT * EXCLUDE (student_id) FROM students"))
def q_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Exact duplicates removed over all (non-id) columns."""
    return ct.dedup(students(spark, sf).drop(ID))


@query("dedup_count", with_(STUDENTS, body="""
SELECT COUNT(*) AS rows_before, (SELECT COUNT(*) FROM (SELECT DISTINCT * EXCLUDE (student_id) FROM students))
       AS rows_after,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * EXCLUDE (student_id) FROM students)) AS removed
FROM students"""))
def q_dedup_count(spark: SparkSession, sf: str) -> DataFrame:
    """Rows removed by the duplicate drop."""
    return ct.dedup_count(students(spark, sf).drop(ID))


def _missing_sql() -> str:
    cols = [ID, *[c for s in STAGE_COLUMNS.values() for c in s], "verification_stage"]
    parts = [f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing FROM stage_union_"
             for c in cols]
    return with_(STUDENTS, STAGE_UNION, body="SELECT * FROM (" + "\nUNION ALL\n".join(parts)
                 + ") WHERE missing > 0")


@query("missing_counts", _missing_sql())
def q_missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    """P5: NULL count per column of the stage union, only columns with NULLs."""
    return ct.missing_counts(_union(spark, sf)).withColumnRenamed("column", "column_name")


def _describe(sql_ctes: list[str], rel: str) -> str:
    return f"(DESCRIBE {with_(*sql_ctes, body=f'SELECT * FROM {rel}')})"


@query("feature_roles", f"""
SELECT column_name,
  CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END AS role
FROM {_describe([STUDENTS, FEATURES], 'features')}
WHERE column_name NOT IN ('student_id', 'dropout_status', 'verification_stage')""")
def q_feature_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric / categorical role of every engineered column, from the schema."""
    f = fx.engineer_features(students(spark, sf))
    return spark.createDataFrame(ct.feature_roles(f.schema), "column_name string, role string")


@query("new_columns", f"""
SELECT column_name FROM {_describe([STUDENTS, FEATURES], 'features')}
WHERE column_name NOT IN (SELECT column_name FROM {_describe([STUDENTS], 'students')})""")
def q_new_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Names the feature transform added (set difference of column names)."""
    s = students(spark, sf)
    return spark.createDataFrame([(c,) for c in fx.new_columns(s, fx.engineer_features(s))],
                                 "column_name string")


@query("shape", with_(STUDENTS, FEATURES, body="SELECT COUNT(*) AS n_rows, 53 AS n_columns FROM features"))
def q_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Row and column counts of the engineered table."""
    return ct.shape(fx.engineer_features(students(spark, sf))) \
        .select(F.col("rows").alias("n_rows"), F.col("columns").alias("n_columns"))


@query("preview", with_(STUDENTS, body="SELECT * FROM students ORDER BY student_id LIMIT 5"))
def q_preview(spark: SparkSession, sf: str) -> DataFrame:
    """P10: first five rows by id (top-k: a limit that is the feature)."""
    return ct.preview(students(spark, sf))


@query("explain_positions", with_(STUDENTS, body="""
SELECT student_id, position FROM (
  SELECT student_id, row_number() OVER (ORDER BY student_id) - 1 AS position,
         COUNT(*) OVER () AS n FROM students)
WHERE position IN (0, n // 4, n // 2, 3 * n // 4, n - 1)"""))
def q_explain_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at positions 0, n/4, n/2, 3n/4, n-1 (distributed ranks)."""
    return ct.sample_positions(students(spark, sf).select(ID)).select(ID, "position")


@query("form_normalise", with_(STUDENTS, body="""
SELECT student_id,
  CASE WHEN scholarship_received = 1 THEN scholarship_amount ELSE 0::DOUBLE END AS scholarship_amount,
  CAST(first_generation <> 0 AS INTEGER) AS first_generation,
  CAST(learning_disability <> 0 AS INTEGER) AS learning_disability,
  CAST(previous_grades AS DOUBLE) AS previous_grades,
  CAST(debt_amount AS DOUBLE) AS debt_amount,
  CAST(study_hours_per_week AS DOUBLE) AS study_hours
FROM students"""))
def q_form_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """P8 conditional zeroing and P9 boolean/number casts of a form submission."""
    s = students(spark, sf)
    return round_doubles(s.select(
        ID,
        F.when(F.col("scholarship_received") == 1, F.col("scholarship_amount"))
        .otherwise(F.lit(0.0)).alias("scholarship_amount"),
        F.col("first_generation").cast("boolean").cast("int").alias("first_generation"),
        F.col("learning_disability").cast("boolean").cast("int").alias("learning_disability"),
        F.col("previous_grades").cast("double").alias("previous_grades"),
        F.col("debt_amount").cast("double").alias("debt_amount"),
        F.col("study_hours_per_week").cast("double").alias("study_hours")))


# ------------------------------------------------------------------ contract


def _contract_sql() -> str:
    checks, counts = [], []
    for f in requests.STUDENT_SCHEMA.fields:
        checks.append(f"CASE WHEN {f.name} IS NULL THEN 'missing:{f.name}' END")
    for name, lo, hi in ct.RANGES:
        bad = f"{name} < {lo}" if hi is None else f"({name} < {lo} OR {name} > {hi})"
        if name in ("previous_grades", "attendance_rate", "scholarship_amount", "debt_amount",
                    "interview_score"):
            bad = f"({bad} OR isnan({name}))"
        checks.append(f"CASE WHEN {bad} THEN 'range:{name}' END")
    counts = " + ".join(f"CASE WHEN ({c}) IS NOT NULL THEN 1 ELSE 0 END" for c in checks)
    return f"concat_ws('|', {', '.join(checks)}) AS violations, CAST({counts} AS INTEGER) AS n_violations"


@query("contract_violations", with_(STUDENTS, STAGE_UNION, body=f"""
SELECT student_id, verification_stage, {_contract_sql()} FROM stage_union_"""))
def q_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Broken rules of every stage-union record (missing fields, ranges)."""
    c = ct.check_contract(_union(spark, sf))
    return c.select(ID, "verification_stage", F.array_join("violations", "|").alias("violations"),
                    F.size("violations").alias("n_violations"))


@query("contract_valid", with_(STUDENTS, body=f"""
SELECT {_BATCH_SQL} AS batch_id, COUNT(*) AS n_rows,
  bool_and(age BETWEEN 16 AND 25 AND family_size BETWEEN 1 AND 10 AND previous_grades BETWEEN 0 AND 100
    AND attendance_rate BETWEEN 0 AND 100 AND interview_score BETWEEN 0 AND 10
    AND career_goals_clarity BETWEEN 1 AND 10 AND emotional_stability BETWEEN 1 AND 10
    AND disciplinary_issues BETWEEN 0 AND 10 AND study_hours_per_week BETWEEN 0 AND 50
    AND extracurricular_activities BETWEEN 0 AND 10) AS batch_valid
FROM students GROUP BY 1"""))
def q_contract_valid(spark: SparkSession, sf: str) -> DataFrame:
    """P7 with ``reject_batch``: a request batch is valid only if every record is."""
    rows = requests.request_rows(requests.build_requests(students(spark, sf), _batch()))
    c = ct.check_contract(rows, "batch_id", reject_batch=True)
    return c.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.bool_and("valid").alias("batch_valid"))


@query("format_fields", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT replace(risk_category, ' ', '_') AS category_key, upper('shap') AS method,
       round(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM scored), 1) AS share_display,
       round(avg(dropout_probability) * 100, 1) AS mean_dropout_pct
FROM scored GROUP BY risk_category"""))
def q_format_fields(spark: SparkSession, sf: str) -> DataFrame:
    """String/format scalars: name cleanup (space -> underscore), upper-case method
    name, display rounding of shares and probabilities."""
    s = scored_df(spark, sf)
    total = s.select(F.count(F.lit(1))).scalar()
    return s.groupBy("risk_category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dropout_probability").alias("p")).select(
        F.regexp_replace("risk_category", " ", "_").alias("category_key"),
        F.upper(F.lit("shap")).alias("method"),
        F.round(F.col("n") * 100.0 / total, 1).alias("share_display"),
        F.round(F.col("p") * 100, 1).alias("mean_dropout_pct"))
