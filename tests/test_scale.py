"""The fit's passes over many rows: exact, and without moving, exploding or keeping rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_moments_and_quantiles_of_many_columns_are_exact(spark):
    from retainlab.functions.columns import moments, quantiles

    rng = np.random.default_rng(3)
    X = np.column_stack([rng.normal(size=1501), np.repeat([3.0, 7.5, 3.0], [700, 1, 800]), rng.exponential(size=1501) * 1e-300,
                         -rng.integers(0, 3, 1501).astype(float), np.full(1501, 0.1), np.full(1501, np.nan), rng.normal(size=1501)])
    X[::3, 0], X[5, 6], X[6, 6] = np.nan, np.inf, -np.inf
    rows = [([None if np.isnan(v) and i % 2 else float(v) for v in x],) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "x array<double>").repartition(7)
    known = moments(df, F.col("x"), 7)
    got = quantiles(df, F.col("x"), [n for n, _, _ in known], [0.25, 0.5, 0.99])
    for j in range(7):
        x = X[~np.isnan(X[:, j]), j]
        assert known[j][0] == len(x)
        if len(x):
            assert got[j] == pytest.approx(np.percentile(x, [25, 50, 99]).tolist(), rel=1e-12, abs=0)
    for j in (0, 1, 3):
        x = X[~np.isnan(X[:, j]), j]
        assert known[j][1:] == pytest.approx((x.mean(), ((x - x.mean()) ** 2).sum()))
    assert known[4][2] == 0.0 and got[5] == [None] * 3


def test_cut_split_is_the_stratified_split(spark):
    from retainlab.operators import split as sp

    rows = [(f"s{i}", (None, 0, 1, 1, 0, 1, 0)[i % 7], i) for i in range(3000)] + [("one", 5, 0)]
    df = spark.createDataFrame(rows, "student_id string, dropout_status int, extra int").repartition(5)
    for pct in ((20, 20), (0, 30), (60, 40)):
        a, b = (f(df, test_pct=pct[0], val_pct=pct[1]) for f in (sp.cut_split, sp.stratified_split))
        assert a.columns == b.columns and a.count() == 3001
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert sp.identified(df) and not sp.identified(df.unionAll(df.limit(1)))
    plan = sp.cut_split(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["prep_all", "prep_apply"])
def test_preprocessing_reads_narrow_stored_rows(spark, name):
    """Only the students' own columns are stored; features and matrix are computed where they are read."""
    from retainlab.plans import all_queries

    plan = all_queries()[0][name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan and "Join" not in plan and "subquery" not in plan


def test_the_matrix_is_not_kept_and_folds_come_on_demand(spark):
    from retainlab.operators import split as sp
    from retainlab.plans import training as tr
    from retainlab.sources.fixture import students

    p = tr.prepared(spark, SF_SMALL)
    assert not p.data.storageLevel.useMemory and "fold" not in p.data.columns
    raw = sp.stratified_split(students(spark, SF_SMALL)).where("split = 'train'")
    folds = sp.kfold(raw).select("student_id", "fold")
    got = p.folded.where("fold IS NOT NULL").select("student_id", "fold")
    assert got.exceptAll(folds).isEmpty() and folds.exceptAll(got).isEmpty()
    assert p.folded.count() == p.data.count() and p.folded.where("split = 'train' AND fold IS NULL").isEmpty()


def vectors(spark, X):
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(f"s{i:03d}", [float(v) for v in x]) for i, x in enumerate(X)], "student_id string, x array<double>")
    return df.select("student_id", array_to_vector("x").alias("features")).repartition(4).cache()


def test_sampled_shapley_scores_only_changes(spark):
    """Steps at which row and background agree are not scored; every feature still has its row."""
    from pyspark.ml.functions import vector_to_array
    from retainlab.operators import shapley as sh

    X = np.zeros((40, 20))
    X[:, :3] = np.random.default_rng(1).normal(size=(40, 3))
    seen = []

    def score(df):
        seen.append(df.count())
        x = vector_to_array("features")
        return df.withColumn("p", x[0] * x[1] + x[2] + x[19])

    points = vectors(spark, X)
    got = sh.sampled_shapley(points, points, score, [f"f{j}" for j in range(20)]).collect()
    assert len(got) == 800 and seen[1] <= 40 * 4 * 4  # 40 * 4 * 21 with all steps
    total, base = np.zeros(40), got[0]["base_value"]
    for r in got:
        total[int(r["student_id"][1:])] += r["contribution"]
        assert r["contribution"] == 0 or r["feature"] in ("f0", "f1", "f2")
        assert r["value"] == X[int(r["student_id"][1:]), int(r["feature"][1:])]
    assert total + base == pytest.approx(X[:, 0] * X[:, 1] + X[:, 2])


def test_linear_importance_is_that_of_the_long_table(spark):
    from retainlab.operators import explain as ex

    points, names, w = vectors(spark, np.random.default_rng(4).normal(size=(200, 6))), list("fedcba"), [1.0, -2.0, 0.5, 0.0, 0.0, 3.0]
    args = (points, points.where("student_id < 's050'"), w, 0.3, names)
    fast = ex.linear_importance(*args, 5)
    assert "Generate" not in fast._jdf.queryExecution().optimizedPlan().toString()
    want = ex.global_importance(ex.linear_shap_vector(*args), 5).collect()
    assert [(r["feature"], pytest.approx(r["importance"])) for r in want] == [tuple(r) for r in fast.collect()]
    assert ex.linear_importance(points.limit(0), *args[1:]).isEmpty()


def test_bins_are_added_up_in_the_tasks(spark, monkeypatch):
    from retainlab.operators import lime as li

    X = np.column_stack([np.random.default_rng(5).normal(size=500), np.repeat([1.0, 2.0], 250), np.full(500, 0.1)])
    points = vectors(spark, X)
    monkeypatch.setattr(li.F, "posexplode", None)  # no row a feature
    disc = li.Discretiser.fit(points, ["a", "b", "c"])
    for j, (cuts, stats) in enumerate(zip(disc.cuts, disc.stats)):
        assert cuts == pytest.approx(sorted(set(np.percentile(X[:, j], [25, 50, 75]))))
        for k, row in enumerate(stats):
            v = X[np.searchsorted(cuts, X[:, j]) == k, j]
            want = (len(v) / 500, v.mean(), v.std(), v.min(), v.max()) if len(v) else (0,) * 5
            assert row == pytest.approx(want, abs=1e-12)
    assert disc.stats[2][0][2] == 0.0


def test_later_passes_read_only_open_columns(spark, monkeypatch):
    """A bin of one value is the answer: a column whose quantiles are known is not read again."""
    from retainlab.functions import columns as co

    rng = np.random.default_rng(8)
    X = np.column_stack([rng.integers(0, 9, 900), rng.integers(1000, 30000, 900), 1 + rng.random(900) * 1e-7, np.full(900, 0.1)]).astype(float)
    X[::5, 1] = np.nan
    df = spark.createDataFrame([([float(v) for v in x],) for x in X], "x array<double>").repartition(5)
    read = []
    for name in ("_bins", "_left"):
        kind = getattr(co, name)
        monkeypatch.setattr(co, name, lambda src, d, slots, kind=kind: (read.append(d), kind(src, d, slots))[1])
    got = co.quantiles(df, F.col("x"), [n for n, _, _ in co.moments(df, F.col("x"), 4)], [0.0, 0.3, 0.5, 1.0])
    assert read == [4, 2, 1]
    for j in range(4):
        assert got[j] == pytest.approx(np.nanpercentile(X[:, j], [0, 30, 50, 100]).tolist(), rel=1e-12, abs=0)


@pytest.mark.parametrize("name, other", [("one_hot", "moments"), ("standard_scale", "_category_stats")])
def test_a_query_fits_only_the_columns_it_returns(spark, monkeypatch, name, other):
    from retainlab.operators import prep as pp
    from retainlab.plans import all_queries
    from retainlab.plans import q_prep as q

    whole = all_queries()[0]["prep_all"](spark, SF_SMALL)
    monkeypatch.setattr(pp, other, None)
    got = all_queries()[0][name](spark, SF_SMALL)
    want = whole.select(got.columns)
    assert got.columns[1:] == (q.FEATURE_NAMES[len(q.NUM):] if name == "one_hot" else q.NUM)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_dummies_are_not_rounded(spark):
    from retainlab.plans import all_queries
    from retainlab.plans.q_prep import NUM

    plan = all_queries()[0]["prep_all"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") <= len(NUM)


def test_naive_bayes_reads_the_rows_in_one_map(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from retainlab.operators.models import GaussianNB

    rng = np.random.default_rng(9)
    X, y = rng.normal(size=(400, 3)) * [1, 5, 0] + [0, 1e6, 0.1], rng.integers(0, 2, 400)
    rows = [([float(v) for v in x], float(t)) for x, t in zip(X, y)] + [([0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").repartition(4)
    monkeypatch.setattr(type(df), "groupBy", None)
    m = GaussianNB().fit(df)
    eps = 1e-9 * np.vstack([X, np.zeros(3)]).var(axis=0).max()
    assert m.getOrDefault("priors") == pytest.approx([(y == c).sum() / 401 for c in (0, 1)])
    for c in (0, 1):
        assert m.getOrDefault("means")[c] == pytest.approx(X[y == c].mean(axis=0).tolist())
        assert m.getOrDefault("variances")[c] == pytest.approx((X[y == c].var(axis=0) + eps).tolist(), rel=1e-6)


def test_naive_bayes_unpacks_a_row_once(spark):
    from retainlab.operators.models import GaussianNB

    points = vectors(spark, np.random.default_rng(2).normal(size=(60, 5)))
    df = points.withColumn("label", (F.substring("student_id", 4, 1).cast("int") % 2).cast("double"))
    scored = GaussianNB().fit(df).transform(df)
    plan = scored.select("prediction")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(features") == 1
    assert scored.columns == [*df.columns, "probability", "prediction"]


def test_matrix_is_packed_as_one_array(spark):
    """The vector column holds what the assembler makes of the processed columns, its names too, NaN for a column without a median."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from retainlab.operators import prep as pp

    rows = [(i, float(i % 7) if i % 3 else None, None, ("a", "b", None)[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x double, none double, c string").repartition(3)
    model = pp.fit_prep(df, ["x", "none"], ["c"])
    got = model.transform(df)
    assert "struct" not in got._jdf.queryExecution().optimizedPlan().toString()
    names = model.feature_names()
    want = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(model.processed(df, keep=["i"]))
    a, b = ({r["i"]: r["v"] for r in t.select("i", vector_to_array("features").alias("v")).collect()} for t in (got, want))
    assert a.keys() == b.keys() and all(np.array_equal(a[i], b[i], equal_nan=True) for i in a)
    attrs = got.schema["features"].metadata["ml_attr"]
    assert attrs["num_attrs"] == len(names) and [x["name"] for x in attrs["attrs"]["numeric"]] == names


@pytest.mark.parametrize("name", ["Decision Tree", "Random Forest"])
def test_deep_trees_are_fitted_on_a_partition_a_core(spark, monkeypatch, name):
    """Every partition sends the statistics of every node: their number must not grow with the input's files."""
    from retainlab.operators import models as md
    from retainlab.plans import training as tr

    cores = spark.sparkContext.defaultParallelism
    p = tr.prepared(spark, SF_SMALL)
    many = tr.Prepared(p.rows.repartition(3 * cores), p.features, p.prep, p.n_train)
    seen = []

    class Fit:
        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))

    monkeypatch.setattr(md, "make_estimator", lambda *_: Fit())
    tr.fit_model(many, name)
    assert seen == [(cores, p.n_train)]


def test_random_features_come_without_an_object_a_row(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array
    from retainlab.operators import models as md
    from retainlab.operators.models import RFFSVMModel

    seen = []
    monkeypatch.setattr(md.F, "pandas_udf", lambda *a: seen.append(a) or F.udf(*a))
    rng = np.random.default_rng(6)
    X, m = rng.normal(size=(90, 5)), RFFSVMModel()
    m.W, m.b = rng.normal(size=(30, 5)), rng.uniform(size=30)
    out = m._features(vectors(spark, X))
    got = {int(r["student_id"][1:]): r["z"] for r in out.select("student_id", vector_to_array("rff").alias("z")).collect()}
    want = np.sqrt(2 / 30) * np.cos(X @ m.W.T + m.b)
    assert np.array([got[i] for i in range(90)]) == pytest.approx(want, abs=1e-12)
    assert "ArrowEvalPython" in str(out._jdf.queryExecution().executedPlan())
    assert seen == []
