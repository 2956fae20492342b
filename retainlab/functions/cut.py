"""Small column-expression helpers shared by the feature groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed binning: ``(e[i], e[i+1]] -> labels[i]``; outside -> NULL.

    ``Bucketizer`` is left-closed, so a CASE chain is used; it stays inside
    whole-stage codegen.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def lookup(x: Column, mapping: dict[str, int]) -> Column:
    """Dictionary mapping; unmapped or NULL -> NULL (CASE, no map literal)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(x == k, F.lit(v)) if expr is None else expr.when(x == k, F.lit(v))
    return expr


def flag(pred: Column) -> Column:
    """Predicate -> 0/1 int; NULL counts as 0 (pandas compares NaN as False)."""
    return F.coalesce(pred.cast("int"), F.lit(0))


def clip(x: Column, lo: float, hi: float) -> Column:
    """``clip(lo, hi)``; NULL stays NULL."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def zero_padded_id(prefix: str, n: Column, width: int = 5) -> Column:
    """``f"{prefix}{n:0{width}d}"``; wider numbers are not truncated."""
    return F.format_string(f"{prefix}%0{width}d", n)


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields NULL on a zero divisor (ANSI mode would raise)."""
    return F.try_divide(a, b)
