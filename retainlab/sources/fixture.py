"""The student table, derived from the driver's order tables.

One student per order.  Stages 1, 3 and 4 come from ``orders`` joined to
``customer``; stage 2 comes from ``lineitem`` aggregated per order.  All
arithmetic is integer so Spark and the SQL twin agree bit for bit.

Scale notes: ``lineitem`` is pre-aggregated per order (map-side partial
aggregation) before any join, so the only full-width shuffles are
orders->custkey and orders->orderkey; AQE picks broadcast vs sort-merge at
runtime from measured sizes and splits skewed custkeys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column order of the student table (the reference's four stages + label).
STAGE_COLUMNS = {
    "stage1": ["age", "gender", "family_income", "parent_education", "family_size",
               "rural_urban", "first_generation"],
    "stage2": ["previous_grades", "attendance_rate", "extracurricular_activities",
               "study_hours_per_week", "subject_preferences", "learning_disability",
               "special_education_needs"],
    "stage3": ["scholarship_received", "scholarship_amount", "financial_aid",
               "work_study_program", "part_time_job", "family_financial_support",
               "debt_amount"],
    "stage4": ["interview_score", "motivation_level", "career_goals_clarity",
               "emotional_stability", "peer_relationships", "teacher_relationships",
               "disciplinary_issues", "dropout_status"],
}
ID = "student_id"
LABEL = "dropout_status"
FEATURE_INPUTS = [c for s in STAGE_COLUMNS.values() for c in s if c != LABEL]
STUDENT_COLUMNS = [ID] + [c for s in STAGE_COLUMNS.values() for c in s]

RURAL_SEGMENTS = ["BUILDING", "FURNITURE", "MACHINERY"]
SCHOLARSHIP_PRIORITIES = ["1-URGENT", "2-HIGH"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_PLANS: dict[tuple, DataFrame] = {}


def memo_plan(spark: SparkSession, key: tuple, build):
    """Reuse an already-built (lazy, immutable) DataFrame plan for this session.

    Building the wide expression trees costs a py4j round trip per node; the
    plan itself holds no data, so sharing it between queries is free.
    """
    k = (id(spark._jsparkSession), *key)
    if k not in _PLANS:
        _PLANS[k] = build()
    return _PLANS[k]


def _levels(x: Column, cuts: list[tuple[int, str]], last: str) -> Column:
    """``x < c0 -> l0, x < c1 -> l1, ..., else last`` (a plain CASE)."""
    expr = None
    for c, label in cuts:
        expr = F.when(x < c, label) if expr is None else expr.when(x < c, label)
    return expr.otherwise(last)


def _order_keys(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """orders ⋈ customer reduced to the integer helpers the columns use."""
    o = orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ck"),
        F.col("o_orderpriority").alias("pr"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    c = customer.select(
        F.col("c_custkey").alias("ck"), F.col("c_acctbal").alias("bal"),
        F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg"))
    return o.join(c, "ck")


def _line_keys(lineitem: DataFrame) -> DataFrame:
    """Per-order line statistics (partial aggregation before the shuffle)."""
    return lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"))


def _student_id(k: Column) -> Column:
    # format_string does not truncate keys wider than 8 digits (lpad would).
    return F.format_string("STU_%08d", k)


def _stage1_cols() -> dict[str, Column]:
    k, ck, bal, nk, seg = (F.col(c) for c in ("k", "ck", "bal", "nk", "seg"))
    return {
        "age": (F.lit(16) + k % 9).cast("bigint"),
        "gender": F.when(k % 25 == 0, "Other").when(k % 2 == 0, "Male").otherwise("Female"),
        "family_income": _levels(bal, [(3000, "Low"), (7000, "Medium")], "High"),
        "parent_education": F.when(nk % 4 == 0, "Primary").when(nk % 4 == 1, "Secondary")
        .when(nk % 4 == 2, "Graduate").otherwise("Postgraduate"),
        "family_size": (F.lit(2) + ck % 6).cast("bigint"),
        "rural_urban": F.when(seg.isin(RURAL_SEGMENTS), "Rural").otherwise("Urban"),
        "first_generation": (nk % 10 < 3).cast("int"),
    }


def _stage2_cols() -> dict[str, Column]:
    n, qty, disc = F.col("n"), F.col("qty"), F.col("disc")
    sp = (qty + n) % 4
    return {
        "previous_grades": (F.lit(40) + qty % 61).cast("double"),
        "attendance_rate": (F.lit(30) + (3 * disc + 11 * n + qty) % 71).cast("double"),
        "extracurricular_activities": (n % 5).cast("bigint"),
        "study_hours_per_week": ((3 * qty + disc) % 40).cast("bigint"),
        "subject_preferences": F.when(sp == 0, "Science").when(sp == 1, "Arts")
        .when(sp == 2, "Commerce").otherwise("Vocational"),
        "learning_disability": (disc % 10 == 0).cast("int"),
        "special_education_needs": (disc % 20 == 1).cast("int"),
    }


def _stage3_cols() -> dict[str, Column]:
    cents, pr = F.col("cents"), F.col("pr")
    return {
        "scholarship_received": pr.isin(SCHOLARSHIP_PRIORITIES).cast("int"),
        "scholarship_amount": F.when(cents % 10 < 4, F.lit(1000) + cents % 9000)
        .otherwise(F.lit(0)).cast("double"),
        "financial_aid": (cents % 10 >= 7).cast("int"),
        "work_study_program": (cents % 100 < 20).cast("int"),
        "part_time_job": (cents % 1000 < 250).cast("int"),
        "family_financial_support": _levels(cents % 7, [(2, "Low"), (5, "Medium")], "High"),
        "debt_amount": (cents % 50000).cast("double"),
    }


def _stage4_cols() -> dict[str, Column]:
    k, ck, cents = F.col("k"), F.col("ck"), F.col("cents")
    return {
        "interview_score": ((3 * cents + k) % 101).cast("double") / 10,
        "motivation_level": _levels((cents + k) % 10, [(2, "Low"), (7, "Medium")], "High"),
        "career_goals_clarity": (F.lit(1) + (5 * cents + k) % 9).cast("bigint"),
        "emotional_stability": (F.lit(1) + (cents + 7 * k) % 9).cast("bigint"),
        "peer_relationships": _levels((cents + ck) % 20, [(3, "Poor"), (13, "Average")], "Good"),
        "teacher_relationships": _levels((7 * cents + ck) % 10, [(1, "Poor"), (5, "Average")], "Good"),
        "disciplinary_issues": ((3 * k + ck) % 10).cast("bigint"),
    }


def _label(cols: dict[str, Column]) -> Column:
    """Rule label (F26) on integer points so both engines agree exactly."""
    from retainlab.functions.label import dropout_points

    noise = (31 * F.col("cents") + 17 * F.col("k")) % 21 - 10
    return ((dropout_points(cols) + noise) > 50).cast("int")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged student table (30 columns), one pass over the three inputs."""
    return memo_plan(spark, ("students", sf_dir), lambda: _students(spark, sf_dir))


def _students(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _order_keys(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))
    base = base.join(_line_keys(read_table(spark, sf_dir, "lineitem")), "k")
    cols = {**_stage1_cols(), **_stage2_cols(), **_stage3_cols(), **_stage4_cols()}
    cols[LABEL] = _label(cols)
    return base.select(_student_id(F.col("k")).alias(ID),
                       *[cols[c].alias(c) for c in STUDENT_COLUMNS[1:]])


def stage_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four verification-stage tables (see :func:`_stage_tables`)."""
    return memo_plan(spark, ("stages", sf_dir), lambda: _stage_tables(spark, sf_dir))


def _stage_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four verification-stage tables, each keyed by ``student_id``.

    Stage 4 carries the label, whose rule reads stage-1/2 values, so it is
    built from the merged inputs (orders without lines have no stage 4 row).
    """
    oc = _order_keys(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))
    lines = _line_keys(read_table(spark, sf_dir, "lineitem"))
    sid = _student_id(F.col("k")).alias(ID)
    s1 = oc.select(sid, *[v.alias(c) for c, v in _stage1_cols().items()])
    s2 = lines.select(sid, *[v.alias(c) for c, v in _stage2_cols().items()])
    s3 = oc.select(sid, *[v.alias(c) for c, v in _stage3_cols().items()])
    cols = {**_stage1_cols(), **_stage2_cols(), **_stage3_cols(), **_stage4_cols()}
    s4 = oc.join(lines, "k").select(
        sid, *[cols[c].alias(c) for c in STAGE_COLUMNS["stage4"][:-1]], _label(cols).alias(LABEL))
    return {"stage1": s1, "stage2": s2, "stage3": s3, "stage4": s4}
