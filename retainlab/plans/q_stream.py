"""Registered queries: streaming scoring (T1) and per-batch statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.functions import features as fx
from retainlab.plans.oracle import FEATURES, SCORED, STUDENTS, with_
from retainlab.plans.q_scoring import SCORE_SQL
from retainlab.plans.registry import query, round_doubles
from retainlab.session import shared_path
from retainlab.sources.fixture import ID, stage_tables, students
from retainlab.sources.requests import STUDENT_SCHEMA, build_requests
from retainlab.streaming import scoring as st


def _inbox(spark: SparkSession, sf: str) -> tuple[str, float]:
    """Write the student rows as request files; return (folder, frozen burden max)."""
    s = students(spark, sf)
    run = uuid.uuid4().hex[:12]
    inbox = shared_path(spark, f"stream/{run}/inbox")
    s.select(*[F.col(f.name).cast(f.dataType) for f in STUDENT_SCHEMA.fields]) \
        .repartition("student_id").write.mode("overwrite").parquet(inbox)
    mx = fx.financial_features(s).agg(F.max("financial_burden")).first()[0]
    return inbox, float(mx)


@query("stream_score", SCORE_SQL)
def q_stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Request files scored by a Structured Streaming query (availableNow) into a
    parquet sink; equals the batch score frame when the frozen max is the batch max."""
    inbox, mx = _inbox(spark, sf)
    base = inbox.rsplit("/", 1)[0]
    scored = st.score_stream(st.read_requests(spark, inbox, max_files_per_trigger=1), mx)
    st.run_to_parquet(scored, f"{base}/scores", f"{base}/ckpt_scores")
    return round_doubles(spark.read.parquet(f"{base}/scores"))


#: files of a micro-batch; a batch's bodies lie in several files, so its state crosses micro-batches
FILES = 8


def _body_inbox(spark: SparkSession, sf: str) -> tuple[str, float]:
    """Every order's intake record as request bodies, two per batch of 100 ids; return (folder, frozen burden max).

    Orders without lines have no stage 2 and 4, so their records lack fields.  The bodies of one batch in 16 are cut off half way.
    """
    stages = stage_tables(spark, sf)
    rows = stages["stage1"]
    for name in ("stage2", "stage3", "stage4"):
        rows = rows.join(stages[name], ID, "left")
    key = F.substring(ID, 5, 20).cast("long")
    half = F.concat((F.floor(key / 100)).cast("string"), F.lit("/"), (key % 2).cast("string"))
    bodies = build_requests(rows, half).select(
        F.regexp_replace("body", '("batch_id":"[0-9]+)/[01]"', '$1"').alias("body"))
    cut = F.regexp_extract("body", '"batch_id":"([0-9]+)"', 1).cast("long") % 16 == 3
    whole = F.when(cut, F.substring("body", F.lit(1), F.floor(F.length("body") / 2).cast("int"))).otherwise(F.col("body"))
    folder = shared_path(spark, f"stream/{uuid.uuid4().hex[:12]}")
    bodies.select(whole.alias("value")).repartition(4 * FILES, F.xxhash64("value")).write.text(f"{folder}/inbox")
    burden = fx.financial_features(students(spark, sf)).agg(F.max("financial_burden")).first()[0]
    return folder, float(burden)


@query("stream_intake")
def q_stream_intake(spark: SparkSession, sf: str) -> DataFrame:
    """JSON bodies through one streaming pass to two exits: scores with recommendations, and quarantined
    records (or unreadable bodies) with the rules they break."""
    folder, burden = _body_inbox(spark, sf)
    st.run_intake(st.read_bodies(spark, f"{folder}/inbox", FILES), f"{folder}/out", f"{folder}/ckpt", burden)
    ok = spark.read.parquet(f"{folder}/out/accepted")
    bad = spark.read.parquet(f"{folder}/out/quarantined")
    return round_doubles(ok.select(
        "batch_id", "student_id", F.lit("accepted").alias("exit"), "dropout_probability", "retention_score", "risk_category",
        F.array_join("recommendations.actions", "|").alias("actions"), F.lit("").alias("violations")).unionByName(bad.select(
            "batch_id", "student_id", F.lit("quarantined").alias("exit"), F.array_join("violations", "|").alias("violations")),
            allowMissingColumns=True))


@query("stream_batch_stats", with_(STUDENTS, FEATURES, SCORED, body="""
SELECT CAST(CAST(substr(student_id, 5) AS BIGINT) // 100 AS VARCHAR) AS batch_id, COUNT(*) AS total_students,
  round(avg(retention_score), 6) AS average_retention_score,
  COUNT(*) FILTER (risk_category = 'Low risk / Highly deserving') AS n_low,
  COUNT(*) FILTER (risk_category = 'Medium risk / Needs monitoring') AS n_medium,
  COUNT(*) FILTER (risk_category = 'High dropout risk / Needs intervention') AS n_high,
  round(COUNT(*) FILTER (risk_category = 'Low risk / Highly deserving') * 100.0::DOUBLE / COUNT(*), 2) AS pct_low,
  round(COUNT(*) FILTER (risk_category = 'Medium risk / Needs monitoring') * 100.0::DOUBLE / COUNT(*), 2) AS pct_medium,
  round(COUNT(*) FILTER (risk_category = 'High dropout risk / Needs intervention') * 100.0::DOUBLE / COUNT(*), 2) AS pct_high
FROM scored GROUP BY 1"""))
def q_stream_batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A4 statistics per request batch, kept up to date across micro-batches by a stateful stream."""
    s = students(spark, sf)
    key = F.substring(ID, 5, 20).cast("long")
    rows = s.select(F.floor(key / 100).cast("string").alias("batch_id"),
                    *[F.col(f.name).cast(f.dataType) for f in STUDENT_SCHEMA.fields])
    folder = shared_path(spark, f"stream/{uuid.uuid4().hex[:12]}")
    rows.repartition(4 * FILES, ID).write.parquet(f"{folder}/inbox")
    burden = float(fx.financial_features(s).agg(F.max("financial_burden")).first()[0])
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/inbox")
    scored = st.score_stream(arriving, burden, keep=["batch_id"])
    st.run_request_stats(scored, f"{folder}/stats", f"{folder}/ckpt")
    return round_doubles(st.latest_stats(spark, f"{folder}/stats"))
