"""Edge rows: nothing disappears, empty input does not crash."""

import pytest
from pyspark.sql import functions as F


def test_malformed_bodies_are_reported(spark):
    from retainlab.sources.requests import malformed_requests, request_rows
    bodies = spark.createDataFrame([('{"batch_id": "1", "students": [{"student_id": "a"}]}',), ("{broken",),
                                    ('{"batch_id": "2", "students": null}',), (None,)], "body string")
    assert request_rows(bodies).count() == 1 and malformed_requests(bodies).count() == 3


def test_rows_without_batch_stay(spark):
    from retainlab.operators.contract import check_contract
    from retainlab.sources.requests import STUDENT_SCHEMA
    rows = spark.createDataFrame([tuple(None for _ in STUDENT_SCHEMA.fields)] * 2, STUDENT_SCHEMA)
    rows = rows.withColumn("batch_id", F.lit(None).cast("string"))
    assert check_contract(rows, "batch_id", reject_batch=True).count() == 2


def test_unreadable_stage_raises(spark, tmp_path):
    from retainlab.sources.files import load_stages
    with pytest.raises(FileNotFoundError):
        load_stages(spark, {"one": str(tmp_path / "absent.csv")})


def test_buckets_of_empty_column(spark):
    from retainlab.functions.ordered import numeric_buckets
    for rows in ([], [(None,), (None,)], [(1.0,), (2.0,)]):
        df = spark.createDataFrame(rows, "x double")
        assert numeric_buckets(df, "x", 1).count() == len(rows)


def test_nan_is_missing_in_preprocessing(spark):
    from retainlab.operators.prep import fit_prep
    rows = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    scaled = [r["x"] for r in fit_prep(rows, ["x"], [], output_col="").processed(rows).collect()]
    assert all(v == v for v in scaled) and scaled[2] == scaled[3] == 0.0


def test_summary_of_an_empty_batch(spark):
    from retainlab.operators.scoring import score_summary
    row = score_summary(spark.createDataFrame([], "retention_score double")).first()
    assert row["total_students"] == 0 and row["median_retention_score"] is None


def test_replayed_epoch_writes_once(spark, tmp_path):
    from retainlab.streaming.scoring import batch_stats_sink
    scored = spark.createDataFrame([("a", 10.0), ("b", 90.0)], "risk_category string, retention_score double")
    write = batch_stats_sink(str(tmp_path / "stats"))
    for epoch in (0, 1, 1):
        write(scored, epoch)
    assert spark.read.parquet(str(tmp_path / "stats")).count() == 2


@pytest.mark.parametrize("name", ["model_comparison", "metrics_long", "roc_auc", "cv_scores", "best_model", "prep_apply",
                                  "classification_report", "confusion_matrix", "shap_local", "shap_positions",
                                  "score_with_actions", "score_summary", "stratified_split"])
def test_students_are_derived_once(spark, name):
    from retainlab.plans import all_queries
    from tests.conftest import SF_SMALL
    plan = all_queries()[0][name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") == 0  # everything reads the written table
