"""Registered queries: preprocessing (X1-X8) and splitting/sampling."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.functions import features as fx
from retainlab.functions.ordered import exact_quantiles
from retainlab.operators import prep as pp
from retainlab.operators import split as sp
from retainlab.plans.oracle import FEATURES, STUDENTS, with_
from retainlab.plans.q_scoring import features_df
from retainlab.plans.registry import query, round_doubles
from retainlab.session import compile_wide_plans, once, stored
from retainlab.sources.fixture import FEATURE_INPUTS, ID, LABEL, memo_plan, students

# Oracle-side knowledge of the fixture: string columns and their (sorted) domains.
CATEGORY_DOMAINS = {
    "gender": ["Female", "Male", "Other"],
    "family_income": ["High", "Low", "Medium"],
    "parent_education": ["Graduate", "Postgraduate", "Primary", "Secondary"],
    "rural_urban": ["Rural", "Urban"],
    "subject_preferences": ["Arts", "Commerce", "Science", "Vocational"],
    "family_financial_support": ["High", "Low", "Medium"],
    "motivation_level": ["High", "Low", "Medium"],
    "peer_relationships": ["Average", "Good", "Poor"],
    "teacher_relationships": ["Average", "Good", "Poor"],
    "academic_performance_category": ["Average", "Excellent", "Good", "Poor"],
    "attendance_category": ["Average", "Excellent", "Good", "Poor"],
    "financial_need_level": ["Low", "Medium", "No Support"],  # High needs aid + scholarship: never
}
ALL_COLS = FEATURE_INPUTS + fx.ENGINEERED
NUM = [c for c in ALL_COLS if c not in CATEGORY_DOMAINS]
CAT = [c for c in ALL_COLS if c in CATEGORY_DOMAINS]
FEATURE_NAMES = NUM + [f"{c}_{v}" for c in CAT for v in CATEGORY_DOMAINS[c]]

SPLIT_SQL = """split_ AS (
  SELECT student_id,
    CASE WHEN rnk * 100 < n * 20 THEN 'test' WHEN rnk * 100 < n * 40 THEN 'val' ELSE 'train' END AS split,
    CAST(rnk % 5 AS INTEGER) AS fold
  FROM (SELECT student_id,
          row_number() OVER (PARTITION BY dropout_status ORDER BY md5(student_id || '#42'), student_id) - 1 AS rnk,
          COUNT(*) OVER (PARTITION BY dropout_status) AS n
        FROM students)
)"""


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def prep_ctes(fit_src: str) -> list[str]:
    med = "med_ AS (SELECT " + ", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in NUM) \
        + f" FROM {fit_src})"
    mom = "mom_ AS (SELECT " + ", ".join(
        f"avg(coalesce(CAST({fit_src}.{c} AS DOUBLE), med_.{c})) AS m_{c}, "
        f"stddev_pop(coalesce(CAST({fit_src}.{c} AS DOUBLE), med_.{c})) AS s_{c}" for c in NUM) \
        + f" FROM {fit_src}, med_)"
    mode = "mode_ AS (SELECT " + ", ".join(
        f"(SELECT {c} FROM {fit_src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS {c}"
        for c in CAT) + ")"
    return [med, mom, mode]


def prep_select(src: str, numeric: bool = True, categorical: bool = True) -> str:
    parts = []
    if numeric:
        parts += [f"round((coalesce(CAST({src}.{c} AS DOUBLE), med_.{c}) - mom_.m_{c}) / "
                  f"CASE WHEN mom_.s_{c} = 0 OR mom_.s_{c} IS NULL THEN 1 ELSE mom_.s_{c} END, 6) AS {c}"
                  for c in NUM]
    if categorical:
        parts += [f"CASE WHEN coalesce({src}.{c}, mode_.{c}) = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
                  f"AS {_q(c + '_' + v)}" for c in CAT for v in CATEGORY_DOMAINS[c]]
    return ", ".join(parts)


def _prep_sql(numeric=True, categorical=True) -> str:
    return with_(STUDENTS, FEATURES, *prep_ctes("features"), body=f"""
SELECT features.student_id, {prep_select('features', numeric, categorical)}
FROM features, med_, mom_, mode_""")


def stored_students(spark: SparkSession, sf: str) -> DataFrame:
    """The student table, written once a session: all features are columns of a row of it and the burden maximum."""
    compile_wide_plans(spark)
    return memo_plan(spark, ("stored students", sf), lambda: stored(students(spark, sf)))


def split_students(spark: SparkSession, sf: str) -> DataFrame:
    """The stored students with their split, written once a session."""
    rows = stored_students(spark, sf)
    return memo_plan(spark, ("split students", sf), lambda: stored(
        sp.cut_split(rows) if sp.identified(rows) else sp.stratified_split(rows)))


def stored_features(rows: DataFrame) -> DataFrame:
    """The features of stored rows with the burden maximum read once."""
    most = fx.financial_features(rows).agg(F.max("financial_burden")).first()[0]
    return fx.engineer_features(rows, F.lit(most).cast("double"))


def fitted_prep(spark: SparkSession, sf: str, num: list[str] = NUM, cat: list[str] = CAT) -> tuple[DataFrame, pp.PrepModel]:
    f = stored_features(stored_students(spark, sf))  # read by the fit and the transform
    return f, pp.fit_prep(f, num, cat, output_col="", keep_input=False)


@query("impute_median", with_(STUDENTS, FEATURES, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round(median(CAST({c} AS DOUBLE)), 6) AS median FROM features"
    for c in NUM)))
def q_impute_median(spark: SparkSession, sf: str) -> DataFrame:
    """Exact median of every numeric feature (distributed ranks)."""
    med = exact_quantiles(features_df(spark, sf), NUM, 0.5)
    return round_doubles(med.select(F.col("column").alias("column_name"), F.col("value").alias("median")))


@query("impute_mode", with_(STUDENTS, FEATURES, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, (SELECT {c} FROM features WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS mode" for c in CAT)))
def q_impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent value of every categorical feature, ties -> smallest."""
    return pp.category_modes(features_df(spark, sf), CAT) \
        .select(F.col("column").alias("column_name"), "mode")


@query("standard_scale", _prep_sql(categorical=False))
def q_standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    """X2 (after X1): (x - mean) / population std, zero std -> 1."""
    f, m = fitted_prep(spark, sf, cat=[])
    return round_doubles(m.processed(f, keep=[ID]))


@query("one_hot", _prep_sql(numeric=False))
def q_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """X4 (after X3): one 0/1 column per sorted category; unknown -> all zeros."""
    f, m = fitted_prep(spark, sf, num=[])
    return m.processed(f, keep=[ID])


@query("prep_all", _prep_sql())
def q_prep_all(spark: SparkSession, sf: str) -> DataFrame:
    """The full processed matrix (39 scaled numeric + 40 dummies), fitted on all rows."""
    f, m = fitted_prep(spark, sf)
    return round_doubles(m.processed(f, keep=[ID]), whole=m.feature_names()[len(NUM):])


@query("feature_names", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}')" for i, n in enumerate(FEATURE_NAMES)) + ") t(position, feature_name)")
def q_feature_names(spark: SparkSession, sf: str) -> DataFrame:
    """Output feature names ``col`` / ``col_value`` in matrix order."""
    _, m = fitted_prep(spark, sf)
    return spark.createDataFrame(list(enumerate(m.feature_names())), "position int, feature_name string")


@query("prep_apply", with_(STUDENTS, FEATURES, SPLIT_SQL,
                          "fit_ AS (SELECT features.* FROM features JOIN split_ USING (student_id) "
                          "WHERE split = 'train')",
                          *prep_ctes("fit_"), body=f"""
SELECT features.student_id, split_.split, {prep_select('features')}
FROM features JOIN split_ USING (student_id), med_, mom_, mode_"""))
def q_prep_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Prep fitted on the training split, applied to every row."""
    f = stored_features(split_students(spark, sf))
    m = pp.fit_prep(f.where(F.col("split") == "train"), NUM, CAT, output_col="", keep_input=False)
    return round_doubles(m.processed(f, keep=[ID, "split"]), whole=m.feature_names()[len(NUM):])


@query("stratified_split", with_(STUDENTS, SPLIT_SQL, body="""
SELECT student_id, dropout_status, split FROM students JOIN split_ USING (student_id)"""))
def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified 60/20/20 split by the seeded hash order."""
    return sp.stratified_split(once(students(spark, sf).select(ID, LABEL)))


@query("kfold", with_(STUDENTS, SPLIT_SQL, body="SELECT student_id, fold FROM split_"))
def q_kfold(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified 5-fold assignment."""
    return sp.kfold(once(students(spark, sf).select(ID, LABEL))).select(ID, "fold")


@query("sample_rows", with_(STUDENTS, body="""
SELECT student_id FROM students ORDER BY md5(student_id || '#42'), student_id LIMIT 100"""))
def q_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """D3: 100 rows without replacement, seeded (the sample is the feature)."""
    return sp.sample_rows(students(spark, sf).select(ID))


@query("background_rows", with_(STUDENTS, body="SELECT student_id FROM students ORDER BY student_id LIMIT 100"))
def q_background_rows(spark: SparkSession, sf: str) -> DataFrame:
    """First 100 rows by id (explainer background)."""
    return sp.background_rows(students(spark, sf).select(ID))


