"""SQL twins (DuckDB dialect) of the student fixture and the derived features.

Used only as the independent correctness oracle: the Spark library never
reads these strings.  Double constants are written as ``::DOUBLE`` so the
arithmetic stays in binary floating point like Spark's, and every division
by a value that can be zero goes through ``NULLIF`` (Spark: ``try_divide``).
"""

from __future__ import annotations


def d(x) -> str:
    return f"{x}::DOUBLE"


def cut_sql(x: str, edges, labels) -> str:
    arms = " ".join(f"WHEN {x} > {d(lo)} AND {x} <= {d(hi)} THEN '{lab}'"
                    for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {arms} END"


def lookup_sql(x: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {arms} END"


def flag_sql(pred: str) -> str:
    return f"COALESCE(CAST(({pred}) AS INTEGER), 0)"


LINES_SQL = """lines_ AS (
  SELECT l_orderkey AS k, COUNT(*) AS n,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
         CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc
  FROM lineitem GROUP BY l_orderkey
)"""

ORDER_CUST_SQL = """oc_ AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderpriority AS pr,
         CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents,
         c.c_acctbal AS bal, c.c_nationkey AS nk, c.c_mktsegment AS seg
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)"""

# Per-column SQL of the student table (helpers k, ck, pr, cents, bal, nk, seg, n, qty, disc).
COL_SQL = {
    "student_id": "printf('STU_%08d', k)",
    "age": "CAST(16 + k % 9 AS BIGINT)",
    "gender": "CASE WHEN k % 25 = 0 THEN 'Other' WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END",
    "family_income": "CASE WHEN bal < 3000 THEN 'Low' WHEN bal < 7000 THEN 'Medium' ELSE 'High' END",
    "parent_education": "CASE WHEN nk % 4 = 0 THEN 'Primary' WHEN nk % 4 = 1 THEN 'Secondary' "
                        "WHEN nk % 4 = 2 THEN 'Graduate' ELSE 'Postgraduate' END",
    "family_size": "CAST(2 + ck % 6 AS BIGINT)",
    "rural_urban": "CASE WHEN seg IN ('BUILDING', 'FURNITURE', 'MACHINERY') THEN 'Rural' ELSE 'Urban' END",
    "first_generation": "CAST(nk % 10 < 3 AS INTEGER)",
    "previous_grades": "CAST(40 + qty % 61 AS DOUBLE)",
    "attendance_rate": "CAST(30 + (3 * disc + 11 * n + qty) % 71 AS DOUBLE)",
    "extracurricular_activities": "CAST(n % 5 AS BIGINT)",
    "study_hours_per_week": "CAST((3 * qty + disc) % 40 AS BIGINT)",
    "subject_preferences": "CASE WHEN (qty + n) % 4 = 0 THEN 'Science' WHEN (qty + n) % 4 = 1 THEN 'Arts' "
                           "WHEN (qty + n) % 4 = 2 THEN 'Commerce' ELSE 'Vocational' END",
    "learning_disability": "CAST(disc % 10 = 0 AS INTEGER)",
    "special_education_needs": "CAST(disc % 20 = 1 AS INTEGER)",
    "scholarship_received": "CAST(pr IN ('1-URGENT', '2-HIGH') AS INTEGER)",
    "scholarship_amount": "CAST(CASE WHEN cents % 10 < 4 THEN 1000 + cents % 9000 ELSE 0 END AS DOUBLE)",
    "financial_aid": "CAST(cents % 10 >= 7 AS INTEGER)",
    "work_study_program": "CAST(cents % 100 < 20 AS INTEGER)",
    "part_time_job": "CAST(cents % 1000 < 250 AS INTEGER)",
    "family_financial_support": "CASE WHEN cents % 7 < 2 THEN 'Low' WHEN cents % 7 < 5 THEN 'Medium' ELSE 'High' END",
    "debt_amount": "CAST(cents % 50000 AS DOUBLE)",
    "interview_score": "CAST((3 * cents + k) % 101 AS DOUBLE) / 10",
    "motivation_level": "CASE WHEN (cents + k) % 10 < 2 THEN 'Low' WHEN (cents + k) % 10 < 7 THEN 'Medium' ELSE 'High' END",
    "career_goals_clarity": "CAST(1 + (5 * cents + k) % 9 AS BIGINT)",
    "emotional_stability": "CAST(1 + (cents + 7 * k) % 9 AS BIGINT)",
    "peer_relationships": "CASE WHEN (cents + ck) % 20 < 3 THEN 'Poor' WHEN (cents + ck) % 20 < 13 THEN 'Average' ELSE 'Good' END",
    "teacher_relationships": "CASE WHEN (7 * cents + ck) % 10 < 1 THEN 'Poor' WHEN (7 * cents + ck) % 10 < 5 THEN 'Average' ELSE 'Good' END",
    "disciplinary_issues": "CAST((3 * k + ck) % 10 AS BIGINT)",
}

STUDENTS = LINES_SQL + ",\n" + ORDER_CUST_SQL + """,
cols_ AS (
  SELECT """ + ",\n    ".join(f"{v} AS {k}" for k, v in COL_SQL.items()) + """,
    (31 * cents + 17 * k) % 21 - 10 AS noise_
  FROM oc_ JOIN lines_ USING (k)
),
students AS (
  SELECT * EXCLUDE (noise_),
    CAST(({points}) + noise_ > 50 AS INTEGER) AS dropout_status
  FROM cols_
)"""

POINTS = " + ".join(f"CASE WHEN {p} THEN {v} ELSE 0 END" for p, v in [
    ("previous_grades < 60", 15), ("attendance_rate < 70", 15), ("family_income = 'Low'", 10),
    ("scholarship_received = 0", 10), ("financial_aid = 0", 10), ("motivation_level = 'Low'", 10),
    ("career_goals_clarity < 5", 10), ("emotional_stability < 5", 5),
    ("peer_relationships = 'Poor'", 5), ("teacher_relationships = 'Poor'", 5),
    ("disciplinary_issues > 5", 5)])

STUDENTS = STUDENTS.replace("{points}", POINTS)


def _features_sql() -> str:
    from retainlab.functions import features as fx

    g = cut_sql("previous_grades", fx.GRADE_EDGES, fx.GRADE_LABELS)
    a = cut_sql("attendance_rate", fx.GRADE_EDGES, fx.GRADE_LABELS)
    inc = lookup_sql("family_income", fx.INCOME_MAP)
    mot = lookup_sql("motivation_level", fx.MOTIVATION_MAP)
    peer = lookup_sql("peer_relationships", fx.RELATION_MAP)
    tea = lookup_sql("teacher_relationships", fx.RELATION_MAP)
    edu = lookup_sql("parent_education", fx.EDUCATION_MAP)
    sup = f"(scholarship_amount + financial_aid * {fx.AID_AMOUNT})"
    need = cut_sql(sup, fx.SUPPORT_EDGES, fx.SUPPORT_LABELS)
    return f"""
f1_ AS (
  SELECT s.*,
    {g} AS academic_performance_category,
    {a} AS attendance_category,
    previous_grades / CASE WHEN study_hours_per_week = 0 THEN 1 ELSE study_hours_per_week END AS study_efficiency,
    (attendance_rate / 100) * {d(0.7)} + (extracurricular_activities / 5) * {d(0.3)} AS academic_engagement,
    {sup} AS total_financial_support,
    {inc} AS family_income_numeric,
    debt_amount / NULLIF(({inc}) * 10000, 0) AS financial_burden,
    scholarship_received * {d(0.4)} + financial_aid * {d(0.3)} + (1 - work_study_program * {d(0.2)})
      + (1 - part_time_job * {d(0.1)}) AS financial_stability,
    {need} AS financial_need_level,
    {mot} AS motivation_score,
    {peer} AS peer_relationship_score,
    {tea} AS teacher_relationship_score,
    ({peer}) * {d(0.5)} + ({tea}) * {d(0.5)} AS social_score,
    (emotional_stability / 10) * {d(0.4)} + (({mot}) / 3) * {d(0.3)} + (career_goals_clarity / 10) * {d(0.3)}
      AS personal_stability,
    {flag_sql("learning_disability = 1")} + {flag_sql("special_education_needs = 1")}
      + {flag_sql("disciplinary_issues > 3")} + {flag_sql("emotional_stability < 5")}
      + {flag_sql("motivation_level = 'Low'")} AS risk_factors_count,
    {edu} AS parent_education_level,
    (1 / NULLIF(family_size, 0)) * (1 + first_generation * {d(0.5)}) AS family_responsibility,
    ({inc}) * {d(0.6)} + ({edu}) * {d(0.4)} AS socioeconomic_status,
    {flag_sql("rural_urban = 'Rural'")} * {flag_sql("family_income = 'Low'")} AS location_disadvantage
  FROM students s
),
bmax_ AS (SELECT max(financial_burden) AS mx FROM f1_),
features AS (
  SELECT f1_.*,
    (previous_grades / 100) * (1 - financial_burden / NULLIF(bmax_.mx, 0)) AS academic_financial_balance,
    personal_stability * academic_engagement AS personal_academic_fit,
    social_score * (1 + total_financial_support / 10000) AS social_financial_support,
    (1 - academic_engagement) * {d(0.3)} + (financial_burden / NULLIF(bmax_.mx, 0)) * {d(0.3)}
      + (1 - personal_stability) * {d(0.2)} + (3 - social_score) / 3 * {d(0.2)} AS overall_risk_score
  FROM f1_ CROSS JOIN bmax_
)"""


FEATURES = _features_sql()

# Frozen scorer + score frame on top of the features.
SCORED = """
prob_ AS (
  SELECT features.*,
    round(1 / (1 + exp(-(2.0::DOUBLE + 2 * (financial_burden / NULLIF(bmax_.mx, 0)) - 4 * academic_engagement))), 6)
      AS dropout_probability
  FROM features CROSS JOIN bmax_
),
scored AS (
  SELECT prob_.*, (1 - dropout_probability) * 100 AS retention_score,
    CASE WHEN isnan((1 - dropout_probability) * 100) OR dropout_probability IS NULL
           THEN 'High dropout risk / Needs intervention'
         WHEN (1 - dropout_probability) * 100 >= 80 THEN 'Low risk / Highly deserving'
         WHEN (1 - dropout_probability) * 100 >= 50 THEN 'Medium risk / Needs monitoring'
         ELSE 'High dropout risk / Needs intervention' END AS risk_category
  FROM prob_
)"""


def with_(*parts: str, body: str) -> str:
    """``WITH`` + the CTE groups (students, features, scored ...) + body."""
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body


def r6(x: str) -> str:
    return f"round({x}, 6)"
