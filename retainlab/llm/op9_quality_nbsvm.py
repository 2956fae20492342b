"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams: lower-cased words (1 and 2) and word shapes
(1 to 3; which classes of characters a word has, its last character if that is
punctuation, and whether it repeats the word before).  Indicators are scaled by the class log-count ratios of the training
documents, every document to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent.  One fold in five of the sample is left out of the fit and
calibrates the margins to probabilities.

The fit reads a bounded sample (``labelled.MAX_FIT`` documents) in one task; the model has
``DIMS`` weights whatever the corpus, so it is broadcast, and scoring is a map over the
whole texts.

Edge cases: null and empty texts have no n-gram and score by the bias alone; without
labels, or with one class only, every score is (positives + 1) / (labels + 2); null ids
are never held out (their remainder is null); repeated rows score alike; an empty table
has no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainlab.llm.labelled import MAX_FIT, platt, sigmoid, training_sample
from retainlab.llm.runtime import fold_of, lean
from retainlab.llm.textwords import SPACE_SPLIT, U, column, mix, ngram_hashes, slices, window_starts, word_hashes, words

BITS = 18
DIMS = 1 << BITS
ALPHA = 1.0        # smoothing of the class counts
C = 1.0            # hinge-loss weight
EPOCHS = 12
KEEP = 0.3         # least score that predicts good quality

_CLASSES = np.zeros(256, np.uint8)
for _b in range(256):
    _ch = chr(_b)
    _CLASSES[_b] = (1 if "A" <= _ch <= "Z" else 2 if "a" <= _ch <= "z" else 4 if "0" <= _ch <= "9"
                    else 8 if _b >= 0x80 else 16 if _ch in "#*$%&|<>" else 32 if _ch in "!?" else 64)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of every text, one text after another, and their ranges."""
    s, e, woff = words(buf, off, SPACE_SPLIT)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    h = word_hashes(buf, s, e)
    cls = np.where(SPACE_SPLIT[buf], _CLASSES[buf], 0).astype(np.uint8)
    bits = np.bitwise_or.reduceat(cls, s)  # the blanks up to the next word add nothing
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    again = np.zeros(len(s), np.uint64)  # the word repeats the one before it
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = buf[e - 1]
    shape = mix(again << U(16) | bits.astype(np.uint64) << U(8) | np.where(_CLASSES[last] >= 16, last, 0).astype(np.uint64))
    keys = []
    for source, sizes, salt in ((h, (1, 2), 1), (shape, (1, 2, 3), 2)):
        for n in sizes:
            at = window_starts(woff, n)
            g = mix(ngram_hashes(source, n)[at] + U(salt * 1000 + n)) >> U(64 - BITS)
            keys.append(doc[at] << BITS | g.astype(np.int64))
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & (DIMS - 1), np.searchsorted(key, np.arange(len(off)) << BITS)


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of the smoothed share of a feature in class 1 over its share in class 0; ``rows``: distinct features."""
    q, p = count = np.full((2, DIMS), ALPHA)
    for f, label in zip(rows, y):
        count[label, f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, c: float = C, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) that minimise |w|^2 / 2 + c * hinge losses; ``rows``: the features of each text."""
    w, alpha = np.zeros(DIMS + 1), np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    rng = np.random.default_rng(0)
    # the rarer class weighs as much as the other one
    limit = c * np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            v = _scaled(f, ratio)
            grad = sign[i] * (w[f] @ v + w[DIMS]) - 1.0
            new = min(max(alpha[i] - grad / (v @ v + 1.0), 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[f] += step * v
                w[DIMS] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def _scaled(f: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The values of a text's features, of length 1; drawn anew when needed, so a fit holds feature numbers only."""
    v = ratio[f]
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def fit_rows(y: np.ndarray, fold: np.ndarray, rows: list[np.ndarray]) -> dict[str, np.ndarray]:
    """ratio, weight (bias last) and calibration (slope, offset) from the features of labelled texts."""
    if len(set(y.tolist())) < 2:
        prior = ((y == 1).sum() + 1) / (len(y) + 2)
        return {"ratio": np.zeros(DIMS), "weight": np.zeros(DIMS + 1), "scale": np.array([0.0, np.log(prior / (1 - prior))])}
    fit = fold != 0
    if len(set(y[fit].tolist())) < 2 or len(set(y[~fit].tolist())) < 2:
        fit = np.ones(len(y), bool)
    fitted = [r for r, a in zip(rows, fit) if a]
    ratio = log_ratios(fitted, np.where(y[fit] == 1, 1, 0))
    w = dual_descent(fitted, ratio, y[fit])
    margin = np.array([w[r] @ _scaled(r, ratio) + w[DIMS] for r in rows])
    rest = ~fit if (~fit).any() else fit
    return {"ratio": ratio, "weight": w, "scale": np.array(platt(margin[rest], y[rest]))}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit: int = MAX_FIT) -> dict[str, np.ndarray]:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, fold, rows = [], [], []
        for batch in batches:
            y += column(batch, "label").to_pylist()
            fold += column(batch, "fold").to_pylist()
            for _, _, buf, off in slices(column(batch, "text")):
                f, at = features(buf, off)
                rows += np.split(f.astype(np.int32), at[1:-1])  # views: the numbers are held once
        model = fit_rows(np.array(y, np.int64), np.array(fold, np.int64), rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array([v.astype("<f8").tobytes() for v in model.values()])],
                                         names=["name", "data"])

    sample = training_sample(docs, labels, label, max_fit=max_fit)
    one = sample.repartition(1).sortWithinPartitions("_o", "text").select("label", "fold", "text")
    fitted = one.mapInArrow(run, "name string, data binary").collect()  # three rows, or none of an empty sample
    return {r["name"]: np.frombuffer(r["data"], "<f8") for r in fitted} or fit_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), [])


def score(docs: DataFrame, model: dict[str, np.ndarray], keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return scored(docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")), model, keep).select(
        "doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def scored(docs: DataFrame, model: dict[str, np.ndarray], keep: float = KEEP, score_col: str = "score",
           flag_col: str = "predicted") -> DataFrame:
    """``docs`` with two more columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w, (slope, offset) = (shared.value[k] for k in ("ratio", "weight", "scale"))
        for batch in batches:
            out = []
            for _, _, buf, off in slices(column(batch, "text")):
                f, at = features(buf, off)
                v = ratio[f]
                c = np.concatenate([[[0.0, 0.0]], np.cumsum(np.stack([w[f] * v, v * v], axis=1), axis=0)])
                dot, norm = (c[at[1:]] - c[at[:-1]]).T
                out.append(sigmoid(slope * (dot / np.sqrt(np.where(norm > 1e-9, norm, 1.0)) + w[DIMS]) + offset))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= keep).astype(np.int32))],
                                             names=[*batch.schema.names, score_col, flag_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{score_col}` double, `{flag_col}` int")
