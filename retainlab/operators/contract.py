"""Data contract of a student record (P7) and data-quality profiles.

The contract is one boolean per rule, evaluated as column expressions; the
broken rule names are collected with ``array_compact`` -- no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainlab.functions.ordered import row_index
from retainlab.sources.requests import STUDENT_SCHEMA

# The API's value ranges (field, lower bound, upper bound or None).
RANGES = [
    ("age", 16, 25), ("family_size", 1, 10), ("first_generation", 0, 1),
    ("previous_grades", 0, 100), ("attendance_rate", 0, 100),
    ("extracurricular_activities", 0, 10), ("study_hours_per_week", 0, 50),
    ("learning_disability", 0, 1), ("special_education_needs", 0, 1),
    ("scholarship_received", 0, 1), ("scholarship_amount", 0, None), ("financial_aid", 0, 1),
    ("work_study_program", 0, 1), ("part_time_job", 0, 1), ("debt_amount", 0, None),
    ("interview_score", 0, 10), ("career_goals_clarity", 1, 10), ("emotional_stability", 1, 10),
    ("disciplinary_issues", 0, 10),
]
REQUIRED = [f.name for f in STUDENT_SCHEMA.fields]


def violations(df: DataFrame) -> Column:
    """Array of broken rule names: ``missing:<field>`` or ``range:<field>``."""
    checks = []
    for name in REQUIRED:
        if name in df.columns:
            checks.append(F.when(F.col(name).isNull(), F.lit(f"missing:{name}")))
        else:
            checks.append(F.lit(f"missing:{name}"))
    for name, lo, hi in RANGES:
        if name not in df.columns:
            continue
        x = F.col(name)
        bad = x < lo if hi is None else (x < lo) | (x > hi)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            bad = bad | F.isnan(x)
        checks.append(F.when(bad, F.lit(f"range:{name}")))
    return F.array_compact(F.array(*checks))


def check_contract(df: DataFrame, batch_col: str | None = None, reject_batch: bool = False) -> DataFrame:
    """Adds ``violations`` and ``valid``.  With ``reject_batch`` one bad record
    invalidates its whole batch (the API rejects the request): a ``bool_and``
    per batch, joined back -- the per-batch table has one row per batch."""
    out = df.withColumn("violations", violations(df)) \
        .withColumn("valid", F.size("violations") == 0)
    if reject_batch:
        if not batch_col:
            raise ValueError("reject_batch needs batch_col")
        # rows without a batch id are a batch of their own: a null-safe join keeps them
        ok = out.groupBy(F.col(batch_col).alias("_batch")).agg(F.bool_and("valid").alias("_batch_valid"))
        out = out.join(ok, F.col(batch_col).eqNullSafe(F.col("_batch"))) \
            .withColumn("valid", F.col("_batch_valid")).drop("_batch", "_batch_valid")
    return out


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    return checked.where("valid").drop("violations", "valid"), checked.where(~F.col("valid"))


# ----------------------------------------------------------------- profiles

def missing_counts(df: DataFrame) -> DataFrame:
    """P5: (column, missing) for columns with at least one NULL; one pass."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = agg.unpivot([], df.columns, "column", "missing")
    return long.where(F.col("missing") > 0)


def dedup(df: DataFrame) -> DataFrame:
    """Exact-duplicate removal over all columns (NULLs compare equal)."""
    return df.dropDuplicates()


def dedup_count(df: DataFrame) -> DataFrame:
    """Rows before, after, and removed, in one aggregation over the distinct rows."""
    per = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.sum("_n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")) \
        .withColumn("removed", F.col("rows_before") - F.col("rows_after"))


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
EXCLUDED = ("student_id", "dropout_status", "verification_stage")


def feature_roles(schema: T.StructType, exclude=EXCLUDED) -> list[tuple[str, str]]:
    """(column, 'numeric' | 'categorical') from the schema, minus exclusions."""
    out = []
    for f in schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, NUMERIC):
            out.append((f.name, "numeric"))
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            out.append((f.name, "categorical"))
    return out


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def preview(df: DataFrame, order: str = "student_id", n: int = 5) -> DataFrame:
    """P10: first rows in a deterministic order (top-k, no global sort of all rows)."""
    return df.orderBy(order).limit(n)


def sample_positions(df: DataFrame, order: str = "student_id") -> DataFrame:
    """Rows at positions 0, n//4, n//2, 3n//4, n-1 of ``order``.

    Positions come from :func:`row_index` (range-partitioned ranks); ``n`` is a
    scalar subquery.
    """
    idx = row_index(df, [order], "position")
    n = df.select(F.count(F.lit(1))).scalar()
    wanted = F.array(F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4), n - 1)
    return idx.where(F.array_contains(wanted.cast("array<bigint>"), F.col("position")))
