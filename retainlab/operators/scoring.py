"""Retention scores, risk tiers, recommendations and cohort statistics.

Everything is a native column expression or a partial/final aggregate: the
per-row recommendation loop of the reference becomes one ``CASE`` building a
struct, and the score frame is computed once and reused (no second scoring
pass for the recommendations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.functions.features import burden_max
from retainlab.functions.ordered import exact_quantiles

# Fixed values that must equal the reference's (tier labels, cut-offs, actions).
LOW = "Low risk / Highly deserving"
MEDIUM = "Medium risk / Needs monitoring"
HIGH = "High dropout risk / Needs intervention"
TIERS = [LOW, MEDIUM, HIGH]
LOW_CUTOFF = 80
MEDIUM_CUTOFF = 50

LOW_ACTIONS = ["Continue academic support", "Provide enrichment opportunities",
               "Consider for leadership roles"]
MEDIUM_ACTIONS = ["Schedule regular counseling sessions", "Monitor academic progress closely"]
HIGH_ACTIONS = ["Immediate intervention required", "Develop personalized success plan",
                "Assign dedicated counselor"]
# (column, comparison, threshold, action) added on top of the base actions.
MEDIUM_RULES = [("attendance_rate", "<", 75, "Address attendance issues"),
                ("previous_grades", "<", 60, "Provide academic tutoring"),
                ("family_income", "==", "Low", "Review financial aid options")]
HIGH_RULES = [("attendance_rate", "<", 60, "Urgent: Address severe attendance issues"),
              ("previous_grades", "<", 50, "Urgent: Provide intensive academic support"),
              ("family_income", "==", "Low", "Urgent: Secure financial assistance"),
              ("emotional_stability", "<", 5, "Urgent: Mental health support")]
PRIORITY = {LOW: ("Low", "Monthly check-ins"), MEDIUM: ("Medium", "Bi-weekly check-ins"),
            HIGH: ("High", "Weekly check-ins")}

REC_TYPE = "struct<priority:string,actions:array<string>,frequency:string>"


def retention_score(p: Column) -> Column:
    """(1 - p) * 100."""
    return (F.lit(1) - p) * 100


def risk_tier(score: Column) -> Column:
    """R2.  NULL/NaN fall to the high tier (in Spark NaN >= 80 would be true)."""
    bad = score.isNull() | F.isnan(score)
    return (F.when(bad, HIGH).when(score >= LOW_CUTOFF, LOW)
            .when(score >= MEDIUM_CUTOFF, MEDIUM).otherwise(HIGH))


def hard_label(p: Column, threshold: float = 0.5) -> Column:
    """1 when p > threshold; NaN/NULL -> 0."""
    return F.when(p.isNull() | F.isnan(p), F.lit(0)).otherwise((p > threshold).cast("int"))


def frozen_logit(df: DataFrame, max_burden: float | Column | None = None) -> Column:
    """Margin of the frozen scorer: 2 + 2*burden/max(burden) - 4*engagement."""
    mx = burden_max(df) if max_burden is None else (
        max_burden if isinstance(max_burden, Column) else F.lit(float(max_burden)))
    return F.lit(2.0) + 2 * F.try_divide(F.col("financial_burden"), mx) - 4 * F.col("academic_engagement")


def frozen_probability(df: DataFrame, max_burden: float | Column | None = None) -> Column:
    """Fixed logistic scorer used wherever a fitted model's output must be SQL-checkable."""
    z = frozen_logit(df, max_burden)
    return F.round(1 / (1 + F.exp(-z)), 6)


def score_frame(df: DataFrame, prob: Column | str = "dropout_probability",
                id_col: str = "student_id", keep: list[str] | None = None) -> DataFrame:
    """(id, probability, retention score, tier) [+ kept feature columns]."""
    p = F.col(prob) if isinstance(prob, str) else prob
    base = df.select(*(keep or []), F.col(id_col) if id_col in df.columns
                     else F.monotonically_increasing_id().cast("string").alias(id_col),
                     p.alias("dropout_probability"))
    s = retention_score(F.col("dropout_probability"))
    return base.select(id_col, "dropout_probability", s.alias("retention_score"),
                       risk_tier(s).alias("risk_category"), *(keep or []))


def _rule(df: DataFrame, col: str, op: str, value, action: str) -> Column | None:
    if col not in df.columns:
        return None
    x = F.col(col)
    cond = x < value if op == "<" else x == value
    return F.when(cond, F.lit(action))


def recommendation(df: DataFrame, tier: Column | str = "risk_category",
                   feature_rules: bool = True) -> Column:
    """struct(priority, actions, frequency) per row, no Python.

    Feature rules apply only when the column is present (R5 passes
    ``feature_rules=False`` or a frame without the features).
    """
    t = F.col(tier) if isinstance(tier, str) else tier

    def actions(base: list[str], rules) -> Column:
        extra = [r for r in (_rule(df, *x) for x in rules) if r is not None] if feature_rules else []
        arr = F.array(*[F.lit(a) for a in base], *extra)
        return F.array_compact(arr) if extra else arr

    def rec(name: str, base, rules) -> Column:
        prio, freq = PRIORITY[name]
        return F.struct(F.lit(prio).alias("priority"), actions(base, rules).alias("actions"),
                        F.lit(freq).alias("frequency"))

    return (F.when(t == LOW, rec(LOW, LOW_ACTIONS, []))
            .when(t == MEDIUM, rec(MEDIUM, MEDIUM_ACTIONS, MEDIUM_RULES))
            .otherwise(rec(HIGH, HIGH_ACTIONS, HIGH_RULES)))


def with_recommendations(scored: DataFrame, feature_rules: bool = True) -> DataFrame:
    return scored.withColumn("recommendations", recommendation(scored, feature_rules=feature_rules))


def score_with_actions(scored: DataFrame, recs: DataFrame, id_col: str = "student_id") -> DataFrame:
    """Score rows joined to the first recommendation row per id.

    The right side is reduced to one row per id with ``min_by`` over its row
    order (a partial aggregate, so a hot id does not land in one task), then
    equi-joined; AQE chooses broadcast or sort-merge from the measured size.
    """
    one = recs.withColumn("_ord", F.monotonically_increasing_id()).groupBy(id_col).agg(
        F.min_by("recommendations", "_ord").alias("recommendations"))
    return scored.join(one, id_col, "left")


# ---------------------------------------------------------------- statistics

def risk_distribution(scored: DataFrame, tier: str = "risk_category") -> DataFrame:
    """A2: (risk_category, count) sorted by count desc."""
    return scored.groupBy(tier).agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.desc("count"), tier)


def risk_percentage(scored: DataFrame, tier: str = "risk_category") -> DataFrame:
    """A3: tier share x100 rounded to 2; the total is a scalar subquery."""
    total = scored.select(F.count(F.lit(1))).scalar()
    return scored.groupBy(tier).agg(F.count(F.lit(1)).alias("count")).select(
        tier, F.round(F.col("count") * 100.0 / total, 2).alias("percentage"))


def score_summary(scored: DataFrame, score: str = "retention_score") -> DataFrame:
    """A1: count, mean, exact median, min, max of the score in one row.

    The median comes from :func:`exact_quantiles` (distributed ranks), not the
    ``percentile`` aggregate, which would hold every distinct value in one task.
    """
    basic = scored.agg(F.count(F.lit(1)).alias("total_students"),
                       F.avg(score).alias("average_retention_score"),
                       F.min(score).alias("min_retention_score"),
                       F.max(score).alias("max_retention_score"))
    med = exact_quantiles(scored, [score], 0.5).select(F.col("value").alias("median_retention_score"))
    return basic.select(  # one row each: the median enters as a scalar (NULL without a score)
        "total_students", "average_retention_score", med.scalar().alias("median_retention_score"),
        "min_retention_score", "max_retention_score")


def batch_stats(scored: DataFrame, batch_col: str | None = None, tier: str = "risk_category",
                score: str = "retention_score") -> DataFrame:
    """A4: total, mean, tier counts and shares; one row per batch if ``batch_col``.

    Tier maps are built from the (batch, tier) counts -- at most 3 rows per
    batch -- so ``collect_list`` is bounded.
    """
    keys = [batch_col] if batch_col else []
    per = scored.groupBy(*keys, tier).agg(F.count(F.lit(1)).alias("n"),
                                           F.sum(score).alias("s"))
    agg = per.groupBy(*keys).agg(
        F.sum("n").alias("total_students"),
        (F.sum("s") / F.sum("n")).alias("average_retention_score"),
        F.map_from_entries(F.collect_list(F.struct(tier, "n"))).alias("risk_distribution"))
    pct = F.map_from_entries(F.transform(
        F.map_entries("risk_distribution"),
        lambda e: F.struct(e["key"], F.round(e["value"] * 100.0 / F.col("total_students"), 2))))
    return agg.withColumn("risk_percentage", pct)


def label_rate(df: DataFrame, label: str = "dropout_status") -> DataFrame:
    """A5: share of positive labels x100."""
    return df.agg((F.avg(F.col(label).cast("double")) * 100).alias("dropout_rate"))


def tier_band(score: Column) -> dict[str, Column]:
    """A6/P12 data of the gauge: band, delta to 50, threshold flag, css class."""
    cat = risk_tier(score)
    return {
        "band": F.when(score < 50, "0-50").when(score < 80, "50-80").otherwise("80-100"),
        "delta_vs_50": score - 50,
        "above_threshold": (score >= 90).cast("int"),
        "css_class": F.when(cat.contains("Low risk"), "risk-low")
        .when(cat.contains("Medium risk"), "risk-medium").otherwise("risk-high"),
    }
