"""Fitted models: AUC floors, saving and loading, exact neighbours, the resumable run and the registry."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import SF_SMALL
from retainlab.operators import models as md


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(600, 6))
    y = (X[:, 0] - 0.8 * X[:, 1] + 0.5 * X[:, 2] + 0.6 * rng.normal(size=len(X)) > 0).astype(float)
    rows = [(f"s{i:04d}", [float(v) for v in x], float(t), i % 3) for i, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "student_id string, x array<double>, label double, part int")
    return df.select("student_id", "label", "part", array_to_vector("x").alias("features")).coalesce(1).cache()


@pytest.mark.parametrize("name", md.MODEL_ORDER)
def test_model_scores_well_and_reloads_equal(spark, points, tmp_path, name):
    from retainlab.operators.metrics import roc_auc

    model = md.make_estimator(name, 400).fit(points.where("part < 2"))
    held = points.where("part = 2")
    scored = md.predict(model, held)
    assert roc_auc(scored, "label", "probability").first()[0] > 0.7
    model.write().overwrite().save(str(tmp_path / "m"))
    again = md.predict(md.load_model(name, str(tmp_path / "m")), held)
    a, b = ({r["student_id"]: r["probability"] for r in x.collect()} for x in (scored, again))
    assert a == b and len(a) == 200


def test_custom_models_are_pipeline_stages(spark, points, tmp_path):
    from pyspark.ml import PipelineModel
    from retainlab.operators.knn import KNNClassifier

    model = PipelineModel(stages=[KNNClassifier(k=3).fit(points)])
    model.write().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert again.stages[0].getOrDefault("k") == 3
    assert md.predict(again, points).exceptAll(md.predict(model, points)).isEmpty()


def test_svm_calibration_is_cross_fitted(spark, points):
    """Probabilities of the cross-fitted scaling stay near the frequencies on rows the model has not seen."""
    def error(folds):
        model = md.RFFSVM(n_components=200, calibration_folds=folds).fit(points.where("part < 2"))
        rows = md.predict(model, points.where("part = 2")).select("probability", "label").toPandas()
        bins = np.minimum((rows["probability"] * 5).astype(int), 4)
        return sum(abs(g["probability"].mean() - g["label"].mean()) * len(g) for _, g in rows.groupby(bins)) / len(rows)

    assert error(3) < min(error(0), 0.12)


@pytest.mark.parametrize("n, k", [(1, 1), (7, 5), (3, 5), (9000, 5)])
def test_nearest_is_exact_with_ties(n, k):
    from retainlab.operators.knn import nearest

    rng = np.random.default_rng(n)
    X = rng.integers(0, 3, size=(n, 4)).astype(float)  # many equal distances
    Q = rng.integers(0, 3, size=(40, 4)).astype(float)
    i, j, d = nearest(Q, X, k)
    for q in range(len(Q)):
        dist = ((X - Q[q]) ** 2).sum(1)
        assert j[i == q].tolist() == np.lexsort((np.arange(n), dist))[:k].tolist()


def test_knn_keeps_the_documented_bound(spark, points):
    from retainlab.operators.knn import KNNClassifier

    model = KNNClassifier(k=3, maxFit=50).fit(points)
    assert len(model.ids) == 50 and model.neighbours(points).count() == 3 * 600


def test_training_run_resumes_and_reports(spark):
    from retainlab.plans.lifecycle import TrainingRun

    names = ["Logistic Regression", "Naive Bayes", "K-Nearest Neighbors"]
    run = TrainingRun(spark, SF_SMALL, names=names).fit()
    assert len(run.fitted) == 18
    again = TrainingRun(spark, SF_SMALL, run_id=run.run_id, names=names)
    assert again.fit().fitted == []  # every table of the run is committed already
    rows = again.report().collect()
    assert {(r["model"], r["split"]) for r in rows} == {(n, s) for n in names for s in ("val", "test")}
    assert all(r["roc_auc"] > 0.7 and r["cv_mean"] > 0.7 for r in rows)
    best = again.best()
    assert best == max((r for r in rows if r["split"] == "val"), key=lambda r: r["roc_auc"])["model"]
    report = {r["class"]: r for r in again.on_test(best).collect()}
    test = again.matrix().where("split = 'test'")
    assert report["accuracy"]["support"] == test.count()
    assert report["0"]["pred_0"] + report["0"]["pred_1"] == test.where("label = 0").count()


def test_registry_keeps_versions(spark, tmp_path):
    from retainlab.plans import training as tr
    from retainlab.plans.lifecycle import TrainingRun
    from retainlab.sources.fixture import students

    run = TrainingRun(spark, SF_SMALL, names=["K-Nearest Neighbors"]).fit()
    pipe = run.pipeline("K-Nearest Neighbors")
    path = str(tmp_path / "registry")
    for auc in (0.7, 0.8):
        tr.save_bundle(spark, pipe, "K-Nearest Neighbors", {"roc_auc": auc}, path)
    assert tr.versions(spark, path).count() == 2
    loaded, row = tr.load_bundle(spark, path, "K-Nearest Neighbors")
    assert row.first()["model_version"] == "1.0.1"
    assert [r["value"] for r in tr.model_info(spark, path).collect()] == [0.8]
    raw = students(spark, SF_SMALL).limit(50).cache()
    assert md.predict(loaded, raw, keep=("student_id",)).exceptAll(md.predict(pipe, raw, keep=("student_id",))).isEmpty()
    with pytest.raises(ValueError):
        tr.load_bundle(spark, path, "K-Nearest Neighbors", 3)


def test_knn_keeps_the_rows_of_smallest_hash_before_they_reach_the_driver(spark, points, monkeypatch):
    import hashlib
    from retainlab.operators.knn import KNNClassifier

    ids = sorted((r["student_id"] for r in points.select("student_id").collect()),
                 key=lambda i: hashlib.md5(f"{i}#42".encode()).hexdigest())
    kind = type(points)
    ordered, limit = [], kind.limit
    monkeypatch.setattr(kind, "limit", lambda df, n: (ordered.append(df.count()), limit(df, n))[1])
    model = KNNClassifier(k=3, maxFit=50).fit(points.repartition(8))
    assert sorted(model.ids) == sorted(ids[:50])
    assert ordered[0] < 60  # of 600
    assert KNNClassifier(k=3).fit(points).X.shape == (600, 6)


def test_knn_compares_with_every_training_row(spark, points, tmp_path, monkeypatch):
    """No bound unless asked for: rows beyond those held are read from a table, block by block, with equal results."""
    from retainlab.operators import knn

    assert knn.KNNClassifier().getOrDefault("maxFit") == 0
    held = knn.KNNClassifier(k=5).fit(points)
    monkeypatch.setattr(knn, "HELD", 100)
    monkeypatch.setattr(knn, "TRAIN_BLOCK", 64)
    model = knn.KNNClassifier(k=5).fit(points.repartition(5))
    assert model.table and not len(model.X) and not len(model.ids)
    model.write().save(str(tmp_path / "m"))
    again = knn.KNNModel.load(str(tmp_path / "m"))
    assert again.table == f"{tmp_path}/m/rows"
    queries = points.repartition(3)
    for m in (model, again):
        assert md.predict(m, queries).exceptAll(md.predict(held, queries)).isEmpty()
        assert m.neighbours(queries).exceptAll(held.neighbours(queries)).isEmpty()


def test_knn_queries_of_one_file_use_all_cores(spark, points):
    from retainlab.operators.knn import KNNClassifier

    model = KNNClassifier(k=3).fit(points)
    assert points.rdd.getNumPartitions() == 1
    assert model.transform(points).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert md.predict(model, points.repartition(40)).exceptAll(md.predict(model, points)).isEmpty()


@pytest.mark.parametrize("scale", [1e-8, 1.0, 1e9, 1e30])
def test_bounds_leave_out_no_neighbour(scale, monkeypatch):
    from retainlab.operators import knn

    monkeypatch.setattr(knn, "TRAIN_BLOCK", 100)
    rng = np.random.default_rng(4)
    X = rng.normal(size=(1500, 40)) * np.geomspace(1, 1e-4, 40) * scale
    X[7], X[1200:1230] = np.nan, X[:30]  # a row without values, equal rows
    X[300] *= 1e6
    Q = np.concatenate([X[:40] + 1e-9 * scale, X[1200:1230], rng.normal(size=(40, 40)) * scale])
    Q[7] = np.nan
    i, j, d = knn.nearest(Q, X, 4)
    for q in range(len(Q)):
        dist = ((X - Q[q]) ** 2).sum(1)
        want = [] if np.isnan(Q[q]).any() else np.lexsort((np.arange(len(X)), dist))[:4].tolist()
        assert j[i == q].tolist() == want


def test_model_info_reloads_the_bundle(spark, monkeypatch):
    from retainlab.plans import all_queries
    from retainlab.plans import training as tr

    loaded, load = [], tr.load_bundle
    monkeypatch.setattr(tr, "load_bundle", lambda *a: loaded.append(load(*a)) or loaded[-1])
    rows = all_queries()[0]["model_info"](spark, SF_SMALL).collect()
    assert len(loaded) == 1 and {r["feature_count"] for r in rows} == {len(loaded[0][0].stages[1].feature_names())}
    assert {r["metric"] for r in rows} == {"accuracy", "precision", "recall", "f1_score", "roc_auc"}

    def other(*a):  # a bundle that does not score like the saved one
        pipe, row = load(*a)
        pipe.stages[2] = tr.fit_model(tr.prepared(spark, SF_SMALL), "K-Nearest Neighbors")
        return pipe, row

    monkeypatch.setattr(tr, "load_bundle", other)
    with pytest.raises(ValueError):
        all_queries()[0]["model_info"](spark, SF_SMALL)
