"""Structured Streaming scoring (T1) and per-batch statistics.

The stream applies exactly the batch plan -- features with the burden maximum
frozen at fit time (a batch maximum would change with every micro-batch),
the scorer, tiers and recommendations -- to request rows as they arrive.
Scoring is stateless.  The statistics of request batches keep running totals
per batch in the state store.  Progress is tracked by the checkpoint in the
shared folder, so a restarted query resumes where it stopped; writers own one
folder per epoch, so a replayed epoch writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from retainlab.functions import features as fx
from retainlab.operators import contract as ct
from retainlab.operators import scoring as sc
from retainlab.sources.requests import REQUEST_SCHEMA, STUDENT_SCHEMA


def read_requests(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Request rows arriving as parquet files in ``path`` (explicit schema)."""
    r = spark.readStream.schema(STUDENT_SCHEMA).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_stream(rows: DataFrame, max_burden: float,
                 probability: Callable[[DataFrame, float], object] | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """T1 transformation: features (frozen max) -> probability -> score frame [+ kept columns]."""
    f = fx.engineer_features(rows, max_burden)
    p = (probability or sc.frozen_probability)(f, max_burden)
    return sc.score_frame(f.withColumn("_p", p), "_p", keep=keep)


def run_to_parquet(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Process everything available now into a parquet sink, then stop."""
    q: StreamingQuery = (df.writeStream.format("parquet").option("path", sink)
                         .option("checkpointLocation", checkpoint).outputMode("append")
                         .trigger(availableNow=True).start())
    q.awaitTermination()


def batch_stats_sink(sink: str) -> Callable[[DataFrame, int], None]:
    """A4 statistics of one micro-batch; a replayed epoch overwrites its own folder, so no row is written twice."""
    def write(batch: DataFrame, epoch: int) -> None:
        st = sc.batch_stats(batch.withColumn("batch_id", F.lit(epoch)), "batch_id")
        st.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
    return write


# ------------------------------------------------------- T1: request bodies, two exits

def read_bodies(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Request bodies (one JSON document per line, column ``body``) arriving as text files in ``path``."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).withColumnRenamed("value", "body")


def assessed(bodies: DataFrame, max_burden: float) -> DataFrame:
    """Every record of every body with its broken rules, score, tier and recommendations.

    A body without a readable list of students is one row of its own, with the rule ``malformed:body``.
    Scores of records that break a rule mean nothing and are null.
    """
    # a body that breaks off would otherwise count as the students read up to there
    schema = T.StructType([*REQUEST_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = bodies.select("body", F.from_json("body", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    whole = F.when(F.col("r._corrupt_record").isNull(), F.col("r.students"))
    rows = parsed.select("body", F.col("r.batch_id").alias("batch_id"), F.explode_outer(whole).alias("s"))
    unread = F.col("s").isNull()
    flat = rows.select("batch_id", unread.alias("_unread"), F.when(unread, F.col("body")).alias("body"), "s.*")
    broken = F.when(F.col("_unread"), F.array(F.lit("malformed:body"))).otherwise(ct.violations(flat))
    f = fx.engineer_features(flat.withColumn("violations", broken), max_burden)
    f = f.withColumn("_p", F.when(F.size("violations") == 0, sc.frozen_probability(f, max_burden)))
    kept = ["batch_id", "body", "violations", "attendance_rate", "previous_grades", "family_income", "emotional_stability"]
    scored = sc.with_recommendations(sc.score_frame(f, "_p", keep=kept))
    valid = F.size("violations") == 0
    return scored.select("batch_id", "student_id", "body", "violations", "dropout_probability", "retention_score",
                         F.when(valid, F.col("risk_category")).alias("risk_category"),
                         F.when(valid, F.col("recommendations")).alias("recommendations"))


def two_exits(sink: str, max_burden: float) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: accepted scores and quarantined records of a micro-batch, from one reading of it.

    Each epoch has a folder of its own at either exit and a replay overwrites it, so a restart neither loses nor repeats a record.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        rows = assessed(batch, max_burden).persist()
        try:
            valid = F.size("violations") == 0
            rows.where(valid).drop("body", "violations").write.mode("overwrite").parquet(f"{sink}/accepted/epoch={epoch}")
            rows.where(~valid).select("batch_id", "student_id", "body", "violations").write.mode("overwrite").parquet(
                f"{sink}/quarantined/epoch={epoch}")
        finally:
            rows.unpersist()
    return write


def run_intake(bodies: DataFrame, sink: str, checkpoint: str, max_burden: float) -> None:
    """Process the bodies available now into both exits, then stop; the checkpoint says where to go on."""
    q = (bodies.writeStream.foreachBatch(two_exits(sink, max_burden))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------- T2: statistics by request batch

TIER_COUNTS = {"n_low": sc.LOW, "n_medium": sc.MEDIUM, "n_high": sc.HIGH}


def request_stats(scored: DataFrame) -> DataFrame:
    """Running totals per request batch (``batch_id``): one small row of state per batch, whatever its size."""
    return scored.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_students"), F.sum("retention_score").alias("score_sum"),
        *[F.count_if(F.col("risk_category") == t).alias(n) for n, t in TIER_COUNTS.items()])


def upsert_sink(sink: str) -> Callable[[DataFrame, int], None]:
    """Writes the batches that a micro-batch has changed; replayed epochs overwrite their own folder."""
    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
    return write


def run_request_stats(scored: DataFrame, sink: str, checkpoint: str) -> None:
    """Keep the statistics of every request batch up to date across micro-batches (stateful, update mode).

    Batches arrive in pieces; the state store holds the totals so far, so no earlier record is read again.
    """
    q = (request_stats(scored).writeStream.outputMode("update").foreachBatch(upsert_sink(sink))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_stats(spark: SparkSession, sink: str) -> DataFrame:
    """A4 per request batch from the newest totals of each."""
    rows = spark.read.parquet(sink)
    last = rows.groupBy("batch_id").agg(F.max_by(F.struct("total_students", "score_sum", *TIER_COUNTS), "epoch").alias("r"))
    n = F.col("r.total_students")
    return last.select("batch_id", n.alias("total_students"), (F.col("r.score_sum") / n).alias("average_retention_score"),
                       *[F.col(f"r.{c}").alias(c) for c in TIER_COUNTS],
                       *[F.round(F.col(f"r.{c}") * 100.0 / n, 2).alias(c.replace("n_", "pct_")) for c in TIER_COUNTS])
