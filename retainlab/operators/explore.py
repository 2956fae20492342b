"""Exploration (V1-V3): histogram and Pearson correlation matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """V1: equal-width bins over [min, max]; the max lands in the last bin.

    min and max are scalar subqueries (one partial/final aggregate); the
    counting is a ``groupBy`` on the bin index.
    """
    lo = df.select(F.min(col).cast("double")).scalar()
    hi = df.select(F.max(col).cast("double")).scalar()
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count")) \
        .select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                (lo + (F.col("bin") + 1) * width).alias("bin_end"), "count")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """V2: pairwise Pearson correlation (pairwise non-null), long form.

    Zero-variance columns give NULL instead of raising: their variance is read
    in the same aggregate and the coefficient guarded.  Each row is read once and
    meets one aggregate buffer per pair; the moments combine before the shuffle, which
    carries one row per pair and task, and the plan does not grow with the pairs.
    """
    cols = list(cols)
    if len(cols) < 2:  # V3: needs more than one numeric column
        raise ValueError("need at least two numeric columns")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    names = F.array(*[F.lit(c) for c in cols])
    first, second = (F.array(*[F.lit(p[k]) for p in pairs]) for k in (0, 1))
    wide = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("_v"))
    long = wide.select("_v", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("_p"))
    long = long.select("_p", F.col("_v")[first[F.col("_p")]].alias("_x"), F.col("_v")[second[F.col("_p")]].alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    x, y = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    m = long.groupBy("_p").agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    a, b = names[first[F.col("_p")]], names[second[F.col("_p")]]
    r = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    sides = F.array(F.struct(a.alias("feature_a"), b.alias("feature_b"), r.alias("correlation")),
                    F.struct(b.alias("feature_a"), a.alias("feature_b"), r.alias("correlation")))
    return m.select(F.explode(F.when(a == b, F.slice(sides, 1, 1)).otherwise(sides)).alias("e")).select("e.*")
