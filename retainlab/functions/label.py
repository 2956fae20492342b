"""Rule label (F26): weighted dropout factors, kept as integer points.

The rule weights 0.15/0.10/0.05 are scaled by 100 to 15/10/5 so the sum is
exact in every engine; the threshold 0.5 becomes 50.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rule (factor, points): must equal the reference's weights x100.
#   previous_grades < 60 -> 15, attendance_rate < 70 -> 15, family_income == Low -> 10,
#   scholarship_received == 0 -> 10, financial_aid == 0 -> 10, motivation_level == Low -> 10,
#   career_goals_clarity < 5 -> 10, emotional_stability < 5 -> 5, peer_relationships == Poor -> 5,
#   teacher_relationships == Poor -> 5, disciplinary_issues > 5 -> 5
THRESHOLD_POINTS = 50


def _c(cols: dict[str, Column] | None, name: str) -> Column:
    return cols[name] if cols is not None and name in cols else F.col(name)


def dropout_points(cols: dict[str, Column] | None = None) -> Column:
    """Sum of integer points; a null factor counts as 0 (False in the reference)."""
    g = lambda n: _c(cols, n)
    factors = [
        (g("previous_grades") < 60, 15),
        (g("attendance_rate") < 70, 15),
        (g("family_income") == "Low", 10),
        (g("scholarship_received") == 0, 10),
        (g("financial_aid") == 0, 10),
        (g("motivation_level") == "Low", 10),
        (g("career_goals_clarity") < 5, 10),
        (g("emotional_stability") < 5, 5),
        (g("peer_relationships") == "Poor", 5),
        (g("teacher_relationships") == "Poor", 5),
        (g("disciplinary_issues") > 5, 5),
    ]
    total = None
    for pred, pts in factors:
        term = F.when(pred, F.lit(pts)).otherwise(F.lit(0))
        total = term if total is None else total + term
    return total


def rule_label(points: Column, noise: Column | None = None) -> Column:
    """1 when points (+ optional integer noise) exceed the threshold."""
    s = points if noise is None else points + noise
    return (s > THRESHOLD_POINTS).cast("int")
