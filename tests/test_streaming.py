"""Streaming intake with two exits and running statistics by request batch: equality with batch, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from retainlab.streaming import scoring as st


def test_both_exits_hold_every_record_once(spark):
    from retainlab.plans.q_scoring import REC_KEEP, scored_df
    from retainlab.operators import scoring as sc
    from retainlab.plans.q_stream import q_stream_intake
    from retainlab.sources.fixture import stage_tables

    out = q_stream_intake(spark, SF_SMALL).cache()
    bad = out.where("exit = 'quarantined'")
    assert not bad.where("violations = 'malformed:body'").isEmpty() and not bad.where("student_id IS NOT NULL").isEmpty()
    assert bad.where("violations = '' OR retention_score IS NOT NULL").isEmpty()
    assert bad.where("student_id IS NOT NULL AND NOT contains(violations, 'missing:previous_grades')").isEmpty()
    ids = stage_tables(spark, SF_SMALL)["stage1"].select("student_id")
    seen = out.where("student_id IS NOT NULL").select("student_id")
    assert seen.count() == seen.distinct().count() and seen.subtract(ids).isEmpty()
    want = sc.with_recommendations(scored_df(spark, SF_SMALL, keep=REC_KEEP)).select(
        "student_id", F.round("retention_score", 6).alias("s"), F.array_join("recommendations.actions", "|").alias("a"))
    got = out.where("exit = 'accepted'").select("student_id", F.col("retention_score").alias("s"), F.col("actions").alias("a"))
    assert got.exceptAll(want).isEmpty()
    lost = want.join(got, "student_id", "left_anti").count()  # only in bodies that were cut off
    assert lost < 100 * bad.where("student_id IS NULL").count()


def test_malformed_and_empty_bodies_are_quarantined(spark):
    bodies = spark.createDataFrame([("not json",), ('{"batch_id": "b"}',), (json.dumps({"batch_id": "c", "students": []}),), (None,),
                                    (json.dumps({"batch_id": "d", "students": [{"student_id": "s1", "age": 99}]}),)], "body string")
    rows = st.assessed(bodies, 1.0).collect()
    assert len(rows) == 5
    by = {r["batch_id"]: r["violations"] for r in rows if r["batch_id"]}
    assert "range:age" in by["d"] and "missing:gender" in by["d"]
    assert all(r["retention_score"] is None and r["recommendations"] is None for r in rows)
    assert sum(r["violations"] == ["malformed:body"] for r in rows) == 3 + 1


@pytest.fixture()
def scored(spark):
    rows = [(f"b{i % 3}", f"s{i}", float(i), st.sc.HIGH if i < 20 else st.sc.LOW) for i in range(40)]
    return spark.createDataFrame(rows, "batch_id string, student_id string, retention_score double, risk_category string")


def test_statistics_survive_a_restart_without_duplicates(spark, scored, tmp_path):
    inbox, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def run():
        rows = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        st.run_request_stats(rows, sink, ckpt)

    scored.where("retention_score < 10").repartition(2).write.parquet(inbox)
    run()
    scored.where("retention_score >= 10").repartition(3).write.mode("append").parquet(inbox)
    run()
    run()  # nothing new
    got = {r["batch_id"]: r for r in st.latest_stats(spark, sink).collect()}
    for b, want in ((r["batch_id"], r) for r in scored.groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg("retention_score").alias("m"),
            F.count_if(F.col("risk_category") == st.sc.LOW).alias("low")).collect()):
        assert (got[b]["total_students"], got[b]["n_low"]) == (want["n"], want["low"])
        assert got[b]["average_retention_score"] == pytest.approx(want["m"])


def test_replayed_epochs_write_once(spark, tmp_path):
    write = st.two_exits(str(tmp_path / "out"), 1.0)
    bodies = spark.createDataFrame([("x",), ("y",)], "body string")
    for epoch in (0, 1, 1):
        write(bodies, epoch)
    assert spark.read.parquet(str(tmp_path / "out/quarantined")).count() == 4
