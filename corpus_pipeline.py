"""The training-data pipeline: quality filter, near-dedup, decontamination, PII redaction, packing.

Each stage works on all rows its predecessor kept; its result is written as Parquet in the
shared checkpoint folder and read again as the next stage's input, so a lost executor
costs at most one stage.  Every stage but the last returns the columns of its input.

Edge cases: null texts count as empty everywhere; empty tables pass through; extra columns
are carried along; rows of equal id and text are one document after the near-dedup stage;
``n_chars``, if there, follows the text that a stage has changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.llm import op1_minhash_neardup as neardup
from retainlab.llm import op7_decontaminate as decontaminate
from retainlab.llm import op8_pii as pii
from retainlab.llm import op9_quality_nbsvm as quality
from retainlab.llm import op10_bestfit_pack as packing
from retainlab.llm.runtime import table
from retainlab.session import shared_path


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _sized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, flag = _free(docs, "_score"), _free(docs, "_flag")
    return quality.scored(docs, model, score_col=score, flag_col=flag).where(F.col(flag) == 1).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (5 words, similarity 0.8): that of the smallest id.

    Rows of equal id and text are one document; if their other columns differ, the row whose other columns
    have the smallest SHA-256 (as JSON) stays.
    """
    key, other, text_key = _free(docs, "_key"), _free(docs, "_id"), _free(docs, "_t")
    kept = (neardup.near_duplicates(docs, shingle=5, num=80, den=100).where("kept")
            .select(F.col("doc_id").alias(other), F.col("text_key").alias(text_key)).distinct())
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(key) == F.col(text_key))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.sha2(F.to_json(F.struct(*rest, F.lit(1).alias(key))).cast("binary"), 256)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    one = (keyed.join(kept, same, "left_semi").groupBy(F.col("doc_id").alias("id"), F.col(key).alias("key"))
           .agg(F.min_by(row, order).alias("row")))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; drop documents that held nothing else."""
    return _sized(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return _sized(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_neardup", keep_one_of_each),
    ("benchmark_decontamination", remove_benchmark),
    ("pii_redaction", redact_personal_data),
    ("bestfit_packing", pack_sequences),
]

#: classifier and packing are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, f"corpus-pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
