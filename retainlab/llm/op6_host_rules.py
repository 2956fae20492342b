"""Host-level quality rules: failure rates by host, shrunk with an empirical beta prior.

``document_rules`` measures every whole text in one map pass and marks the rows that fail
a rule.  ``host_verdicts`` counts rows and failures by host (partial sums before the
shuffle), fits a beta prior to the host rates by the method of moments and takes the
posterior mean as the host's rate.  A host is refused if that rate is above ``MAX_RATE``, or if
it is an outlier: the posterior probability that its rate exceeds the average host's by more
than ``MARGIN`` is at least 95 % (normal approximation: mean - ``Z`` deviations of the beta
posterior).  A host of few rows is drawn to the average and stays.  ``apply_hosts`` joins the
verdicts back: a document is kept if it passes the rules and its host is not refused.

Prior: with host rates x_h over H hosts, mean m and population variance v,
strength a + b = m * (1 - m) / v - 1, kept within [MIN_STRENGTH, MAX_STRENGTH]; no spread
(v = 0), one host or none gives MAX_STRENGTH.

Edge cases: a null text has no words and fails the rules; rows with a null host are
judged by their own rules alone; empty tables give empty results; repeated rows count as
often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainlab.llm.runtime import cut, lean
from retainlab.llm.textwords import (SAME, SPACE_SPLIT, byte_table, column, ngram_hashes, slices, window_starts,
                                     word_hashes, words)

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_RATE = 0.5
#: a host may fail this much more often than the average host; standard normal quantile of 95 %
MARGIN, Z = 0.1, 1.645
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
#: hosts whose verdicts may be broadcast (about 50 bytes each); more are joined by a shuffle
MAX_BROADCAST_HOSTS = 100_000

SYMBOLS = byte_table(lambda b: chr(b) in "#*$%&|<>")
CONTINUES = byte_table(lambda b: 0x80 <= b <= 0xBF)
BLANK = " \t\n\v\f\r"


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def repeated_words(h: np.ndarray, woff: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Per text: words inside ``n``-word windows that the text holds twice or more."""
    out = np.zeros(len(woff) - 1, np.int64)
    pos = window_starts(woff, n)
    if not len(pos):
        return out
    g = ngram_hashes(h, n)[pos]
    doc = np.searchsorted(woff, pos, "right") - 1
    bounds = np.searchsorted(doc, np.arange(len(out) + 1))
    for k in np.flatnonzero(np.diff(bounds) > 1):
        own = g[bounds[k]:bounds[k + 1]]
        ranked = np.sort(own)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            cover = np.zeros(len(own) + n, np.int64)
            at = np.flatnonzero(np.isin(own, twice))
            cover[at] += 1
            cover[at + n] -= 1
            out[k] = int((np.cumsum(cover) > 0).sum())
    return out


def document_rules(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, the measures and base_failed, one row per row of ``docs``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            for first, last, buf, off in slices(column(batch, "text")):
                s, e, woff = words(buf, off, SPACE_SPLIT, SAME)
                lines = [[x for x in (t or "").split("\n") if x.strip(BLANK)] for t in texts[first:last]]
                cols = [np.diff(woff), _sums(SPACE_SPLIT[buf] & ~CONTINUES[buf], off), _sums(SYMBOLS[buf], off),
                        np.array([len(x) - len(set(x)) for x in lines]),
                        repeated_words(word_hashes(buf, s, e, SAME), woff)]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, c).slice(first, last - first) for c in ("doc_id", "host")]
                    + [pa.array(c, pa.int64()) for c in cols], names=["doc_id", "host", *names])

    src = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"),
                      F.col(f"`{host_col}`").cast("string").alias("host"), F.col("`text`").alias("text"))
    out = src.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{n} long" for n in names))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(rules: DataFrame, max_rate: float = MAX_RATE, margin: float = MARGIN) -> DataFrame:
    """host, host_docs, host_failed, host_rate (posterior mean), host_floor (its lower bound), host_kept."""
    hosts = rules.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    m, v = moments.select("m").scalar(), moments.select("v").scalar()
    raw = m * (1 - m) / v - 1
    strength = F.when(v > 0, F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), raw))).otherwise(MAX_STRENGTH)
    post = (F.col("host_failed") + m * strength) / (F.col("host_docs") + strength)
    sd = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("host_docs") + strength + 1))
    return (hosts.withColumn("host_rate", post).withColumn("host_floor", F.col("host_rate") - Z * sd)
            .withColumn("host_kept", (F.col("host_rate") <= max_rate) & (F.col("host_floor") <= m + margin)))


def apply_hosts(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rules`` with host_rate and kept."""
    hosts = verdicts.select("host", "host_rate", "host_kept")
    if hosts.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    return (rules.join(hosts, "host", "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))))


def host_filter(docs: DataFrame, host_col: str = "source", max_rate: float = MAX_RATE, margin: float = MARGIN) -> DataFrame:
    rules = cut(document_rules(docs, host_col))
    return apply_hosts(rules, cut(host_verdicts(rules, max_rate, margin)))
