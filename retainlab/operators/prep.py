"""Preprocessing (X1-X8): median/mode imputation, population scaling, one-hot.

Fitting runs a few distributed aggregations, whatever the row count:

* mean and deviation of all numeric columns in one map (``columns.moments``), corrected
  for the imputed rows afterwards (*population* std);
* their exact medians at once by radix selection (``columns.quantiles``): counting maps,
  no row is exploded or shuffled;
* per categorical column the value counts (one ``groupBy(column, value)`` over
  an exploded long form), from which the mode (ties -> smallest value,
  ``min_by`` on ``(-count, value)``) and the sorted category list are read.

Only the fitted parameters -- one number per column and the category lists --
reach the driver, like any Spark ML model.  ``transform`` is a single
``select`` of column expressions (coalesce, arithmetic, CASE per category),
packed into the vector as one array; the fitted state is stored as ML params, so
the model persists with the standard ML writer and can sit in a
``PipelineModel``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.functions.columns import merge, moments, quantiles
from retainlab.operators.contract import EXCLUDED, feature_roles

# Above this many distinct values a column is not one-hot encoded (the
# category list is fitted state held by the model, so it must stay bounded).
MAX_CATEGORIES = 10000


class _PrepParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric input columns",
                        TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical input columns",
                            TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "assembled vector column (empty: none)",
                      TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], outputCol="features")


class PrepEstimator(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits median/mode imputation, standard scaling and one-hot encoding."""

    #: False for an input that is as cheap to read again as a persisted one
    keep_input = True

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, outputCol="features"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PrepModel":
        if not self.keep_input:
            return self._fit_persisted(df)
        # Several aggregations read the input: keep it (memory, spilling to
        # disk) for the duration of the fit instead of recomputing its lineage.
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit_persisted(df)
        finally:
            df.unpersist()

    def _fit_persisted(self, df: DataFrame) -> "PrepModel":
        num = list(self.getOrDefault("numericCols"))
        cat = list(self.getOrDefault("categoricalCols"))
        if not num and not cat:
            roles = feature_roles(df.schema, EXCLUDED)
            num = [c for c, r in roles if r == "numeric"]
            cat = [c for c, r in roles if r == "categorical"]
        medians, means, stds = [], [], []
        if num:
            values = F.array(*[_number(c) for c in num])
            known = moments(df, values, len(num))
            medians = [m for m, in quantiles(df, values, [n for n, _, _ in known], [0.5])]
            rows = df.count()
            for m, x in zip(medians, known):
                if m is not None:
                    x = merge(x, (rows - x[0], m, 0.0))
                means.append(x[1] if x[0] else None)
                stds.append((x[2] / x[0]) ** 0.5 if x[0] else None)
        modes, cats = [], []
        if cat:
            modes, cats = _category_stats(df, cat)
        model = PrepModel(numericCols=num, categoricalCols=cat,
                          outputCol=self.getOrDefault("outputCol"))
        model._set(medians=[_f(x) for x in medians], means=[_f(x) for x in means],
                   stds=[_f(x) for x in stds], modes=modes, categories=cats)
        return model


def _number(c: str) -> Column:
    """The column as double; NaN counts as missing, like NULL."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _f(x):
    return float("nan") if x is None else float(x)


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for every non-NULL value of each categorical column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def category_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mode); most frequent value, ties -> smallest (``min_by`` is a
    partial aggregate, so a hot value never gathers rows in one task)."""
    return category_counts(df, cols).groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def _category_stats(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[list[str]]]:
    """Mode and sorted distinct values per column (bounded before collecting)."""
    # one row beyond what all columns together may have proves that a column has too many
    most = MAX_CATEGORIES * len(cols)
    rows = category_counts(df, cols).limit(most + 1).collect()
    by: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        by[r["column"]].append((-r["n"], r["value"].encode(), r["value"]))
    too_many = [c for c, vs in by.items() if len(vs) > MAX_CATEGORIES]
    if too_many:
        raise ValueError(f"too many categories to one-hot encode: {too_many}")
    modes = [min(by[c])[2] if by[c] else "" for c in cols]
    cats = [[v for _, v in sorted((b, v) for _, b, v in by[c])] for c in cols]
    return modes, cats


class PrepModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted preprocessing; ``transform`` adds ``feature_names`` columns (+ vector)."""

    medians = Param(Params._dummy(), "medians", "median per numeric column", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean after imputation", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population std after imputation", TypeConverters.toListFloat)
    modes = Param(Params._dummy(), "modes", "mode per categorical column", TypeConverters.toListString)
    categories = Param(Params._dummy(), "categories", "sorted categories per column",
                       TypeConverters.identity)

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(medians=[], means=[], stds=[], modes=[], categories=[])
        self._set(**self._input_kwargs)

    # -- fitted state accessors
    def feature_names(self) -> list[str]:
        """``col`` for numeric, ``col_value`` per category, in output order."""
        num = list(self.getOrDefault("numericCols"))
        cats = self.getOrDefault("categories")
        return num + [f"{c}_{v}" for c, vs in zip(self.getOrDefault("categoricalCols"), cats) for v in vs]

    def stats(self) -> list[tuple]:
        """(column, median, mean, std) of the numeric part."""
        g = self.getOrDefault
        return list(zip(g("numericCols"), g("medians"), g("means"), g("stds")))

    def columns(self) -> list:
        """Column expressions of the processed matrix, named by :meth:`feature_names`."""
        g = self.getOrDefault
        out = []
        for c, med, mu, sd in zip(g("numericCols"), g("medians"), g("means"), g("stds")):
            x = _number(c)
            if med == med:  # not NaN: a median exists
                x = F.coalesce(x, F.lit(med))
            scale = 1.0 if (sd != sd or sd == 0.0) else sd
            out.append(((x - F.lit(mu)) / F.lit(scale)).alias(c))
        for c, mode, vs in zip(g("categoricalCols"), g("modes"), g("categories")):
            x = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            for v in vs:
                out.append(F.when(x == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}"))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.feature_names()
        out_col = self.getOrDefault("outputCol")
        if not out_col:
            wide = df.select("*", *[x.alias(f"__p_{i}") for i, x in enumerate(self.columns())])
            keep = [c for c in df.columns if c not in set(names)]
            return wide.select(*keep, *[F.col(f"__p_{i}").alias(n) for i, n in enumerate(names)])
        # one array instead of a column an entry: the assembler would read every entry from a row of its own
        entries = F.array(*[F.coalesce(x, F.lit(float("nan"))) for x in self.columns()])
        attrs = [{"idx": i, "name": n} for i, n in enumerate(names)]
        return df.withColumn(out_col, array_to_vector(entries)).withMetadata(
            out_col, {"ml_attr": {"attrs": {"numeric": attrs}, "num_attrs": len(names)}})

    def processed(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Wide form: kept columns + one double column per feature name."""
        return df.select(*keep, *self.columns())


def fit_prep(df: DataFrame, numeric: Sequence[str] | None = None,
             categorical: Sequence[str] | None = None, output_col: str = "features", keep_input: bool = True) -> PrepModel:
    """Identify roles (P4) unless given, fit, return the model."""
    kw = {"outputCol": output_col}
    if numeric is not None or categorical is not None:
        kw.update(numericCols=list(numeric or []), categoricalCols=list(categorical or []))
    est = PrepEstimator(**kw)
    est.keep_input = keep_input
    return est.fit(df)
