"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in its hashed
words and word pairs, and the document's is the noisy-or 1 - prod(1 - p).  The weights are
trained from document labels alone, by adaptive gradient steps on the documents'
likelihood; the sentence scores then locate the offending sentences.

Sentences end at ``.``, ``!``, ``?`` or a line feed; words are runs of lower-cased letters, digits
and non-ASCII characters.  Only features of at least ``MIN_DOCS`` documents of the sample
have a weight, shrunk smoothly by its evidence and by L2.  The fit reads a bounded sample (``labelled.MAX_FIT`` documents) in one task; the
model has ``DIMS`` weights and is broadcast; scoring is a map over the whole texts.

Edge cases: null and empty texts, or texts without a word, are one empty sentence;
without labels, or with one class only, every score is (positives + 1) / (labels + 2);
null ids are never held out; repeated rows score alike; ties of the worst sentence go to
the first; an empty table has no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainlab.llm.labelled import MAX_FIT, sigmoid, training_sample
from retainlab.llm.runtime import fold_of, lean
from retainlab.llm.textwords import ALNUM_SPLIT, U, byte_table, column, mix, ngram_hashes, slices, word_hashes, words

BITS = 18
DIMS = 1 << BITS
MIN_DOCS = 5
HALF = 12.0      # deviance at which a weight is halved
POWER = 4
EPOCHS = 15
RATE = 0.5
DECAY = 1e-4     # L2
START_BIAS = -4.0

ENDS = byte_table(lambda b: chr(b) in ".!?\n")


def sentences(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Features of every sentence.

    f, row: feature numbers and the sentence they belong to; doc: the text of each sentence; begin, end: its bytes.
    Every text has at least one sentence.
    """
    s, e, woff = words(buf, off, ALNUM_SPLIT)
    cut = np.concatenate([[0], np.cumsum(ENDS[buf])]) if len(buf) else np.zeros(1, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    first = np.ones(len(s), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (cut[s[1:]] != cut[e[:-1]])
    sent = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    begin, end = s[at], e[np.concatenate([at[1:], [len(s)]]) - 1] if len(at) else e
    owner = doc[at]
    empty = np.flatnonzero(np.diff(woff) == 0)
    h = word_hashes(buf, s, e)
    one = ngram_hashes(h, 1)
    two = ngram_hashes(h, 2)
    inner = np.flatnonzero(~first[1:]) if len(s) else np.zeros(0, np.int64)
    f = np.concatenate([mix(one + U(1)), mix(two[inner] + U(2))]) >> U(64 - BITS)
    row = np.concatenate([sent, sent[inner]])
    return {"f": f.astype(np.int64), "row": row, "doc": np.concatenate([owner, empty]),
            "begin": np.concatenate([begin, off[:-1][empty]]), "end": np.concatenate([end, off[:-1][empty]])}


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) of each text's sentences."""
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def shrinkage(y: np.ndarray, bags: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Scale of each feature's weight, below 1; 0 only under MIN_DOCS documents.

    It grows smoothly with the deviance of the feature's documents from the share of toxic ones (the likelihood ratio
    holds for few documents too), so a word of five toxic documents and no clean one is hardly shrunk.
    """
    seen = np.zeros((2, DIMS))
    for label, b in zip(y, bags):
        seen[label, np.unique(b["f"])] += 1
    n, share = seen.sum(axis=0), np.array([[(y == 0).mean()], [(y == 1).mean()]])
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * np.where(seen > 0, seen * np.log(seen / (n * share)), 0.0).sum(axis=0)
    power = np.maximum(deviance, 0.0) ** POWER
    return np.where(n >= MIN_DOCS, power / (power + HALF ** POWER), 0.0)


def fit_bags(y: np.ndarray, bags: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Weights (the bias last).  ``bags``: one dict of ``sentences`` per document."""
    if len(set(y.tolist())) < 2:
        prior = ((y == 1).sum() + 1) / (len(y) + 2)
        return np.concatenate([np.zeros(DIMS), [np.log(prior / (1 - prior))]])
    scale = shrinkage(y, bags)
    rows = []
    for b in bags:
        mine = scale[b["f"]] > 0
        rows.append((b["f"][mine], b["row"][mine], len(b["doc"])))
    # steps are taken on u, the weight is u times its scale
    u, square = np.zeros(DIMS), np.full(DIMS, 1e-2)
    bias, bias_square = START_BIAS, 1e-2
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, row, n = rows[i]
            s = scale[f]
            p = sigmoid(np.bincount(row, s * u[f], n) + bias)
            miss = np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
            # d log-likelihood / d z: -p for a clean document, p (1 - P) / P for a toxic one
            d = -p if y[i] == 0 else p * (miss / max(1 - miss, 1e-9))
            g = s * d[row] - DECAY * u[f]
            np.add.at(square, f, g * g)
            np.add.at(u, f, RATE * g / np.sqrt(square[f]))
            gb = d.sum()
            bias_square += gb * gb
            bias += 0.1 * gb / np.sqrt(bias_square)
    return np.concatenate([scale * u, [bias]])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_fit: int = MAX_FIT) -> np.ndarray:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, bags = [], []
        for batch in batches:
            y += column(batch, "label").to_pylist()
            for first, last, buf, off in slices(column(batch, "text")):
                bags += [sentences(buf[off[k]:off[k + 1]], np.array([0, off[k + 1] - off[k]])) for k in range(last - first)]
        w = fit_bags(np.array(y, np.int64), bags)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()])], names=["data"])

    sample = training_sample(docs, labels, label, max_fit=max_fit)
    one = sample.repartition(1).sortWithinPartitions("_o", "text").select("label", "text")
    fitted = one.mapInArrow(run, "data binary").first()  # one row, or none of an empty sample
    return np.frombuffer(fitted["data"], "<f8") if fitted else fit_bags(np.zeros(0, np.int64), [])


def score(docs: DataFrame, weights: np.ndarray, flag: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, n_offending, worst_start, worst_end (bytes), worst_score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value[:DIMS], shared.value[DIMS]
        for batch in batches:
            for first, last, buf, off in slices(column(batch, "text")):
                n, b = last - first, sentences(buf, off)
                p = sigmoid(np.bincount(b["row"], w[b["f"]], len(b["doc"])) + bias)
                total = noisy_or(p, b["doc"], n)
                rank = np.lexsort((b["begin"], -p, b["doc"]))
                worst = rank[np.searchsorted(b["doc"][rank], np.arange(n))]
                cols = [pa.array(total), pa.array((total >= flag).astype(np.int32)), pa.array(np.bincount(b["doc"], minlength=n)),
                        pa.array(np.bincount(b["doc"], p >= flag, n).astype(np.int64)), pa.array(b["begin"][worst] - off[:-1]),
                        pa.array(b["end"][worst] - off[:-1]), pa.array(p[worst])]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(first, n), *cols], names=[
                    "doc_id", "score", "predicted", "n_sentences", "n_offending", "worst_start", "worst_end", "worst_score"])

    src = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    out = src.mapInArrow(run, "doc_id long, score double, predicted int, n_sentences long, n_offending long, worst_start long, "
                              "worst_end long, worst_score double")
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, *out.columns[1:])
