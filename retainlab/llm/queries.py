"""Registered queries of the subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.llm import op1_minhash_neardup as op1
from retainlab.llm import op2_preference_format as op2
from retainlab.llm import op3_toxicity_mil as op3
from retainlab.llm import op4_language_id as op4
from retainlab.llm import op5_ppm as op5
from retainlab.llm import op6_host_rules as op6
from retainlab.llm import op7_decontaminate as op7
from retainlab.llm import op8_pii as op8
from retainlab.llm import op9_quality_nbsvm as op9
from retainlab.llm import op10_bestfit_pack as op10
from retainlab.llm import op11_spelling_variants as op11
from retainlab.llm import op12_fill_in_middle as op12
from retainlab.llm import op13_simhash_neardup as op13
from retainlab.llm import sql
from retainlab.llm.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


@_query("op1_minhash_neardup", sql.OP1)
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100).drop("text_key")


@_query("op2_preference_format", sql.OP2)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.digest(op2.format_pairs(op2.stale_reply_pairs(table(spark, sf_dir, "conversations"))))


@_query("op3_toxicity_mil")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op3.score(docs, op3.train(docs, table(spark, sf_dir, "labels")))


@_query("op4_language_id")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@_query("op5_ppm_score")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.score(table(spark, sf_dir, "documents"))


@_query("op6_host_rules", sql.OP6)
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.host_filter(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 6).alias("host_rate"))


@_query("op7_decontaminate", sql.OP7)
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.report(op7.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@_query("op8_pii_boosting")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.report(op8.find_spans(table(spark, sf_dir, "documents")))


@_query("op9_quality_nbsvm")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op9.score(docs, op9.train(docs, table(spark, sf_dir, "labels")))


@_query("op10_bestfit_pack")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.pack(table(spark, sf_dir, "documents"))


@_query("op11_spelling_variants")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.grouped(table(spark, sf_dir, "documents"))


@_query("op12_fill_in_middle", sql.OP12)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.digest(op12.fill_in_middle(table(spark, sf_dir, "documents")))


@_query("op13_simhash_neardup")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.digest(op13.near_duplicates(table(spark, sf_dir, "documents")))
