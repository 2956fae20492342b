"""Bounded samples of labelled documents, and calibration, for the trained classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retainlab.llm.runtime import cut, fold_of

#: most labelled documents that a fit reads (documented bound; chosen by the hash of the id)
MAX_FIT = 16_000
#: most bytes of text that a fit reads, and most of one of its texts (longer ones are not fitted on, but scored whole)
MAX_FIT_BYTES, MAX_TEXT_BYTES = 128 << 20, 1 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int = 5, max_fit: int = MAX_FIT,
                    max_bytes: int = MAX_FIT_BYTES) -> DataFrame:
    """(label, fold, _o, text): one text for each of at most ``max_fit`` labelled ids whose crc32 remainder is not 0.

    Null ids and null labels are left out; an id with several labels takes the greatest, one with several texts
    that of the smallest hash, and its copies are one row.  Texts of more than ``MAX_TEXT_BYTES`` are left out, and
    ids are taken in the order of their hash while their texts have at most ``max_bytes`` in total.  So neither
    the rows nor the bytes of the one fitting task grow with the tables.  Texts are picked where they are scanned:
    only hashes and lengths of the sample are ranked, and its (bounded) list of ids is broadcast.
    """
    ids = (labels.select(F.col("`doc_id`").cast("long").alias("_id"), F.col(f"`{label}`").cast("int").alias("label"))
           .where("_id IS NOT NULL AND label IS NOT NULL").where(fold_of("_id", parts) != 0)
           .groupBy("_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("_id"), "_id").limit(max_fit))
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    src = docs.select(F.col("`doc_id`").cast("long").alias("_id"), text.alias("text"))
    key = F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("size")).alias("key")
    found = (src.select("_id", key).where(F.col("key.size") <= MAX_TEXT_BYTES).join(F.broadcast(ids), "_id")
             .groupBy("_id").agg(F.min("key").alias("key"), F.max("label").alias("label"))
             .withColumn("_o", F.xxhash64("_id")))
    # at most max_fit rows of numbers: one task may rank them
    total = F.sum("key.size").over(Window.orderBy("_o", "_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = cut(found.withColumn("total", total).where(F.col("total") <= max_bytes).drop("total"))
    fold = F.pmod(F.xxhash64(F.col("_id"), F.lit(7)), F.lit(5)).cast("int").alias("fold")
    return (src.select("_id", key, "text").join(F.broadcast(chosen), ["_id", "key"])
            .groupBy("_id").agg(F.max("label").alias("label"), F.max("_o").alias("_o"), F.first("text").alias("text"))
            .select("label", fold, "_o", "text"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic fit of ``y`` on ``margin`` (smoothed targets, Newton steps)."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(steps):
        p = sigmoid(w @ x)
        grad = x @ (t - p) - 1e-3 * w
        hess = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
