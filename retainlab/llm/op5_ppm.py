"""Language-model scoring by prediction by partial matching (PPM) on bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes with the counts of the bytes
that follow them in the training texts.  A text is its UTF-8 bytes and an end symbol;
contexts at its beginning are filled with a start symbol.  The probability of a byte is
taken at the longest context that has seen it; each longer context on the way escapes
with its number of distinct symbols (method C), and symbols that a longer context has
seen are excluded from the counts of the shorter one.  Below order 0 the remaining
symbols are equally likely.  The code length of a text is the sum of its bytes' log10
probabilities (pretrained: counts of the training texts, not updated while scoring).

How it scales.  A byte's probability depends on its ``ORDER + 1``-gram alone.  The grams
of all texts are counted per slice and summed by a shuffle; the trie levels, escapes and
exclusions are joins and windows over the table of distinct grams, in which a context
has at most 256 symbols.  Texts are then scored by chunk: a chunk (about ``CHUNK_BYTES``
of text) asks for the grams and words it holds and gets their values back by a shuffle,
so nothing that grows with the corpus is broadcast.

The unigram baseline (``base_score``) goes the same way, over lower-cased words and one end token.

Edge cases: null and empty texts are the end symbol alone; a training set without
texts gives uniform bytes and N = V = 0; a null id is never held out (its remainder is
null); repeated rows count as often as they occur; an empty table has no row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retainlab.llm.runtime import cut, lean
from retainlab.llm.textwords import LOWER, SPACE_SPLIT, U, column, slices, word_hashes, words

ORDER = 4
CHUNK_BYTES = 12 << 20
START, END = 0xFE, 0xFF   # bytes that UTF-8 never uses
SYMBOLS = 255             # every byte value but START
END_TOKEN = 0x0E4D        # hash of the end token


def grams(buf: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram of every byte and end symbol, as integers, and each text's range."""
    n = np.diff(off)
    at = np.concatenate([[0], np.cumsum(n + order + 1)])
    wide = np.full(at[-1], START, np.uint8)
    wide[at[1:] - 1] = END
    doc = np.repeat(np.arange(len(n)), n)
    wide[np.arange(len(buf)) + (doc + 1) * order + doc] = buf
    g = np.zeros(len(wide) - order, np.uint64)
    for j in range(order + 1):
        g = (g << U(8)) | wide[j:len(wide) - order + j]
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    keep = np.arange(begin[-1]) + np.repeat(np.arange(len(n)), n + 1) * order
    return g[keep].astype(np.int64), begin


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    u, inv = np.unique(key, return_inverse=True)
    return u, np.bincount(inv, n, len(u)).astype(np.int64)


def _tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.concatenate([first, [len(key)]]))


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text, then its end token; ranges of the texts."""
    s, e, woff = words(buf, off, SPACE_SPLIT)
    h = word_hashes(buf, s, e, LOWER).astype(np.int64)
    return np.insert(h, woff[1:], END_TOKEN), woff + np.arange(len(woff))


def chunked(docs: DataFrame, parts: int = 7, test: int = 2) -> DataFrame:
    """(chunk, doc_id, held_out, text), dealt evenly by chunk, about CHUNK_BYTES of text in each."""
    src = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == test, F.lit(False))
    chunks = -(-size // CHUNK_BYTES)
    rows = src.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", held.alias("held_out"), "text")
    # explicit, so that gathering and scoring read one and the same exchange
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, "chunk").sortWithinPartitions("chunk")


def gather(rows: DataFrame, order: int = ORDER, words_too: bool = True) -> DataFrame:
    """(chunk, kind, key, n): training counts of a chunk's grams (kind 0) and words (kind 1), 0 if only held out.

    Rows of a chunk follow one another; ``chunk`` may also be a constant, then every task adds up its own rows.
    """
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        chunk = None

        def flush():
            for kind, parts in enumerate(held):
                if parts:
                    key, n = _merge(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), chunk, np.int64)), pa.array(np.full(len(key), kind, np.int8)),
                         pa.array(key), pa.array(n)], names=["chunk", "kind", "key", "n"])

        for batch in batches:
            chunks = column(batch, "chunk").to_numpy()
            for a, b in _runs(chunks):
                if chunks[a] != chunk:
                    yield from flush()
                    chunk, held = int(chunks[a]), [[], []]
                part = batch.slice(a, b - a)
                out = column(part, "held_out").to_numpy(zero_copy_only=False)
                for first, last, buf, off in slices(column(part, "text")):
                    train = ~out[first:last]
                    own = [grams(buf, off, order)] + ([_tokens(buf, off)] if words_too else [])
                    for kind, (key, at) in enumerate(own):
                        mine = np.repeat(train, np.diff(at))
                        held[kind].append(_tally(key[mine]))
                        other = _tally(key[~mine])[0]
                        held[kind].append((other, np.zeros(len(other), np.int64)))
                        if len(held[kind]) > 32:
                            held[kind] = [_merge(held[kind])]
        yield from flush()

    return rows.mapInArrow(run, "chunk long, kind byte, key long, n long")


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(x)])) if len(x) else []


def trie(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, value): log10 probability of the last byte of every gram after the others.

    ``counts``: (gram, n) over (order + 1)-grams, n = 0 for grams of held-out texts only.  Level k has, for each
    (k + 1)-gram: c, its count; t and d, the total and the number of distinct symbols of its context; x, the count
    at level k - 1 of the symbols its context has seen; and r, the log10 probability of its symbol once its context
    has escaped, with the context's symbols excluded (used where c = 0).
    """
    level = None
    for k in range(order + 1):
        mask = (1 << 8 * (k + 1)) - 1
        own = counts.select(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("c"))
        ctx = Window.partitionBy(F.shiftright("gram", 8)) if k else Window.partitionBy(F.lit(0))
        seen = F.col("c") > 0
        if level is None:  # one context, at most 256 rows
            level = own.select("gram", "c", F.sum("c").over(ctx).alias("t"),
                               F.sum(seen.cast("long")).over(ctx).alias("d"), F.lit(0).cast("long").alias("x"))
            level = level.withColumn("r", -F.log10(F.lit(SYMBOLS) - F.col("d")))
        else:
            below = level.select(F.col("gram").alias("_s"), F.col("c").alias("_c"), F.col("t").alias("_t"),
                                 F.col("d").alias("_d"), F.col("r").alias("_r"))
            own = own.join(below, F.col("gram").bitwiseAND(F.lit(mask >> 8)) == F.col("_s"))
            own = own.select("*", F.sum("c").over(ctx).alias("t"), F.sum(seen.cast("long")).over(ctx).alias("d"),
                             F.sum(F.when(seen, F.col("_c")).otherwise(0)).over(ctx).alias("x"))
            total, kinds = F.col("_t") - F.col("x"), F.col("_d") - F.col("d")
            r = (F.when(F.col("c") > 0, F.lit(0.0))
                 .when(F.col("_c") > 0, F.log10(F.col("_c") / (total + kinds)))
                 .when(total + kinds > 0, F.log10(kinds / (total + kinds)) + F.col("_r"))
                 .otherwise(F.col("_r")))
            level = own.select("gram", "c", "t", "d", "x", r.alias("r"))
        level = cut(level)
    c, t, d = F.col("c"), F.col("t"), F.col("d")
    value = F.when(c > 0, F.log10(c / (t + d))).when(t > 0, F.log10(d / (t + d)) + F.col("r")).otherwise(F.col("r"))
    return level.select("gram", value.alias("value"))


def gram_counts(docs: DataFrame, order: int = ORDER, parts: int = 7, test: int = 2) -> DataFrame:
    """(gram, n) of all texts: each task adds up what it scans, the shuffle adds up the tasks."""
    held = F.coalesce(F.crc32(F.col("`doc_id`").cast("string").cast("binary")) % parts == test, F.lit(False))
    rows = docs.select(F.lit(0).cast("long").alias("chunk"), held.alias("held_out"), F.col("`text`").alias("text"))
    return gather(rows, order, words_too=False).groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n"))


def score(docs: DataFrame, order: int = ORDER, parts: int = 7, test: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, one row per row of ``docs``."""
    value = trie(cut(gram_counts(docs, order, parts, test)), order)
    rows = chunked(docs, parts, test)
    # Each chunk asks for its grams and words; one shuffle by key brings the answers together (a key has at most
    # one row a chunk), a second one takes them back.  ``fresh`` marks one row of each training word.
    asked = gather(rows, order).withColumn("value", F.lit(None).cast("double")).unionByName(value.select(
        F.lit(None).cast("long").alias("chunk"), F.lit(0).cast("byte").alias("kind"), F.col("gram").alias("key"),
        F.lit(0).cast("long").alias("n"), "value"))
    same = Window.partitionBy("kind", "key")
    total = F.sum("n").over(same)
    answers = asked.select(
        "chunk", "kind", "key",
        F.when(F.col("kind") == 1, F.log10(total + 1)).otherwise(F.max("value").over(same)).alias("value"),
        ((F.col("kind") == 1) & (total > 0) & (F.col("chunk") == F.min("chunk").over(same))).alias("fresh")
    ).where("chunk IS NOT NULL")

    def run(text: pa.Table, need: pa.Table) -> pa.Table:
        kind, key, val = (need.column(c).to_numpy() for c in ("kind", "key", "value"))
        by_key = np.argsort(key, kind="stable")
        kind, key, val = kind[by_key], key[by_key], val[by_key]
        tables = [(key[kind == k], val[kind == k]) for k in (0, 1)]
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, _, buf, off in slices(text.column("text")):
            sums = []
            for (keys, vals), (own, at) in zip(tables, (grams(buf, off, order), _tokens(buf, off))):
                u, inv = np.unique(own, return_inverse=True)
                sums.append((vals[np.searchsorted(keys, u)][inv], at))
            (ppm, gram_at), (tok, tok_at) = sums
            known = (tok > 0).astype(np.int64)  # log10(c + 1) is 0 only for c = 0
            for out, x in zip(cols, (np.diff(tok_at), np.add.reduceat(known, tok_at[:-1]), np.add.reduceat(tok, tok_at[:-1]),
                                     np.add.reduceat(ppm, gram_at[:-1]), np.diff(off))):
                out.append(x)
        done = [np.concatenate(x) if x else np.zeros(0) for x in cols]
        fresh = np.zeros(text.num_rows, np.int64)
        if len(fresh):
            fresh[0] = need.column("fresh").to_numpy().sum()
        return pa.table({"doc_id": text.column("doc_id"), "held_out": text.column("held_out"),
                         "n_tokens": pa.array(done[0], pa.int64()), "n_known": pa.array(done[1], pa.int64()),
                         "_logs": pa.array(done[2], pa.float64()), "score": pa.array(done[3], pa.float64()),
                         "n_bytes": pa.array(done[4], pa.int64()), "_fresh": fresh})

    out = cut(rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, _logs double, score double, n_bytes long, "
             "_fresh long"))
    n_train, vocab = out.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)),
                             F.coalesce(F.sum("_fresh"), F.lit(0))).first()
    base = F.col("_logs") - F.col("n_tokens") * F.lit(float(np.log10(n_train + vocab + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
                      base.alias("base_score"), "score", "n_bytes")
