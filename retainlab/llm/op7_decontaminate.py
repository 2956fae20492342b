"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of lower-cased ASCII letters, digits and non-ASCII characters.
A window is ``n`` consecutive words of one benchmark item; an item with fewer
words, but not none, is one window of its own length.  Every document window is
looked up by hash, every hash hit is verified on the words themselves, and the
words inside a verified occurrence are hit.  ``scan`` reports, ``remove_spans``
cuts the hit spans out of the texts (again and again until no window is left).

The set is broadcast only below ``max_broadcast`` bytes of windows; a larger
benchmark is cut into hash shards of at most that size, each broadcast to its
own pass over the documents, and the hits are united per document before anything
is cut, round by round.

Edge cases: null or empty texts (either side) have no words and no windows; null
item ids mark words but are not listed; repeated items and windows count once per
id; an empty benchmark hits nothing; extra columns are ignored by ``scan`` and
kept by ``remove_spans``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainlab.llm.runtime import cut, lean
from retainlab.llm.textwords import (ALNUM_SPLIT, LOWER, column, ngram_hashes, slices, window_starts,
                                     word_hashes, words)

N = 10
#: bytes of window words that one broadcast may hold
MAX_BROADCAST = 64 << 20


def _norm(buf: np.ndarray, s: np.ndarray, e: np.ndarray, first: int, n: int) -> bytes:
    """The words themselves, lower-cased and joined by a space."""
    return b" ".join(LOWER[buf[s[i]:e[i]]].tobytes() for i in range(first, first + n))


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows of all items: (h, n, words, item_ids)."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "item_id").to_pylist()
            for first, last, buf, off in slices(column(batch, "text")):
                s, e, woff = words(buf, off, ALNUM_SPLIT)
                h = word_hashes(buf, s, e)
                out: list[tuple] = []
                for k in range(last - first):
                    a, b = int(woff[k]), int(woff[k + 1])
                    size = min(n, b - a)
                    if size:
                        for i, g in enumerate(ngram_hashes(h[a:b], size)):
                            out.append((int(g.astype(np.int64)), size, _norm(buf, s, e, a + i, size), ids[first + k]))
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
                     pa.array(cols[3], pa.string())], names=["h", "n", "words", "item_id"])

    src = benchmark.select(F.col("`item_id`").cast("string").alias("item_id"), F.col("`text`").cast("string").alias("text"))
    return (src.mapInArrow(run, "h long, n int, words binary, item_id string")
            .groupBy("h", "n", "words").agg(F.collect_set("item_id").alias("item_ids")))


def window_table(rows: list) -> dict[int, tuple]:
    """Windows by length: (sorted hashes, bit filter in front of them, words to verify, item ids).

    Plain arrays and lists, so a broadcast of them is read without this package.
    """
    by_len: dict[int, tuple] = {}
    for n in sorted({r["n"] for r in rows}):
        own = sorted((r for r in rows if r["n"] == n), key=lambda r: r["h"] & (1 << 64) - 1)
        keys = np.array([r["h"] for r in own], np.int64).astype(np.uint64)
        bits = np.zeros(1 << 22, bool)
        bits[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        by_len[n] = (keys, np.packbits(bits), [bytes(r["words"]) for r in own], [list(r["item_ids"]) for r in own])
    return by_len


def occurrences(table: dict[int, tuple], buf: np.ndarray, off: np.ndarray) -> tuple[tuple, list[tuple[int, int, list]]]:
    """Word table of the slice and the verified occurrences of ``table``'s windows (first word, length, item ids)."""
    s, e, woff = words(buf, off, ALNUM_SPLIT)
    h = word_hashes(buf, s, e)
    found = []
    for n, (keys, bits, text, items) in table.items():
        pos = window_starts(woff, n)
        if not len(pos):
            continue
        g = ngram_hashes(h, n)[pos]
        low = (g & np.uint64((1 << 22) - 1)).astype(np.int64)
        maybe = np.flatnonzero(bits[low >> 3] >> (7 - (low & 7)) & 1)
        for i, p in zip(np.searchsorted(keys, g[maybe]), maybe):
            while i < len(keys) and keys[i] == g[p]:
                if _norm(buf, s, e, int(pos[p]), n) == text[i]:
                    found.append((int(pos[p]), n, items[i]))
                i += 1
    return (s, e, woff), found


def _shards(benchmark: DataFrame, n: int, max_broadcast: int) -> Iterator:
    """One broadcast, or one per hash shard when the windows exceed ``max_broadcast`` bytes."""
    sc = benchmark.sparkSession.sparkContext
    w = cut(windows(benchmark, n))
    size = w.agg(F.sum(F.octet_length("words") + 64 + 32 * F.size("item_ids"))).first()[0] or 0
    parts = max(1, -(-int(size) // max_broadcast))
    for k in range(parts):  # each shard is bounded: at most max_broadcast bytes in expectation
        yield sc.broadcast(window_table(w.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == k).collect()))


def _scan_shard(docs: DataFrame, shared) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for first, last, buf, off in slices(column(batch, "text")):
                (s, _, woff), found = occurrences(table, buf, off)
                hit: list[list[int]] = [[] for _ in range(last - first)]
                items: list[set] = [set() for _ in range(last - first)]
                for p, n, ids in found:
                    k = int(np.searchsorted(woff, p, "right")) - 1
                    hit[k] += range(p - int(woff[k]), p - int(woff[k]) + n)
                    items[k].update(ids)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "_row").slice(first, last - first), pa.array(np.diff(woff), pa.int64()),
                     pa.array([sorted(set(x)) for x in hit], pa.list_(pa.int32())),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["_row", "n_words", "hit", "items"])

    return docs.mapInArrow(run, "_row struct<doc_id:long,key:long>, n_words long, hit array<int>, items array<string>")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: doc_id, n_words, hit (word numbers inside occurrences), items (sorted ids)."""
    src = docs.select(F.struct(F.col("`doc_id`").cast("long").alias("doc_id"),
                               F.xxhash64(F.col("`text`")).alias("key")).alias("_row"),
                      F.col("`text`").alias("text"))
    shards = list(_shards(benchmark, n, max_broadcast))
    if len(shards) == 1:
        out = _scan_shard(src, shards[0])
    else:  # repeated rows stay: each shard returns every row once, so a count divides them out
        out = None
        for b in shards:
            part = _scan_shard(src, b)
            out = part if out is None else out.unionByName(part)
        out = (out.groupBy("_row").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            (F.count(F.lit(1)) / len(shards)).cast("int").alias("_times"))
            .withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "hit", "items")


def report(hits: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, the hash of the item list, the verdict."""
    return hits.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"))


def _without(raw: bytes, s: np.ndarray, e: np.ndarray, hit: np.ndarray) -> str:
    """The text without the spans from the first to the last word of each run of hits."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        out.append(raw[at:s[a]])
        at = int(e[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def _has_word(text: str) -> bool:
    return bool(ALNUM_SPLIT[LOWER[np.frombuffer(text.encode(), np.uint8)]].any())


def clean_text(table: dict[int, tuple], text: str) -> str:
    """Cut the hits until none is left."""
    while True:
        raw = text.encode()
        buf = np.frombuffer(raw, np.uint8)
        (s, e, _), found = occurrences(table, buf, np.array([0, len(buf)]))
        if not found:
            return text
        hit = np.zeros(len(s), bool)
        for p, n, _ in found:
            hit[p:p + n] = True
        text = _without(raw, s, e, hit)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with hit spans cut out of ``text``; a document left without a word is dropped.

    A document that had no word before is not hit and stays as it is.  The result does not depend on the
    number of shards: each round cuts the hits that all shards found on the same text.
    """
    shards = list(_shards(benchmark, n, max_broadcast))
    return _remove_at_once(docs, shards[0]) if len(shards) == 1 else _remove_in_rounds(docs, shards)


def _remove_at_once(docs: DataFrame, shared) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for first, _, buf, off in slices(batch.column(at)):
                (_, _, woff), found = occurrences(table, buf, off)
                for k in {int(np.searchsorted(woff, p, "right")) - 1 for p, _, _ in found}:
                    texts[first + k] = clean_text(table, texts[first + k])
                    keep[first + k] = _has_word(texts[first + k])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(
                pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _hits_of_shard(texts: DataFrame, shared) -> DataFrame:
    """(_key, hit) of the texts that hold a window of the shard."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for first, last, buf, off in slices(column(batch, "text")):
                (_, _, woff), found = occurrences(table, buf, off)
                hit: dict[int, set] = {}
                for p, n, _ in found:
                    k = int(np.searchsorted(woff, p, "right")) - 1
                    hit.setdefault(k, set()).update(range(p - int(woff[k]), p - int(woff[k]) + n))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "_key").slice(first, last - first).take(pa.array(list(hit), pa.int64())),
                     pa.array([sorted(x) for x in hit.values()], pa.list_(pa.int32()))], names=["_key", "hit"])

    return texts.mapInArrow(run, "_key string, hit array<int>")


def _remove_in_rounds(docs: DataFrame, shards: list) -> DataFrame:
    """Each round unites the hits of all shards on the unchanged texts and cuts them; changed texts go on to the next.

    A shard is one pass of its own, so a worker holds one shard at a time.  Hits depend on the text alone and are
    joined by its SHA-256; a round takes at least a word from every text it goes on with, so the rounds end.
    """
    names = docs.columns
    at = names.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, hits = column(batch, "_row"), column(batch, "hit").to_pylist()
            parts = [row.field(i) for i in range(len(names))]
            texts, keep = parts[at].to_pylist(), np.ones(batch.num_rows, bool)
            for k, hit in enumerate(hits):
                if hit:
                    raw = texts[k].encode()
                    buf = np.frombuffer(raw, np.uint8)
                    s, e, _ = words(buf, np.array([0, len(buf)]), ALNUM_SPLIT)
                    mask = np.zeros(len(s), bool)
                    mask[hit] = True
                    texts[k] = _without(raw, s, e, mask)
                    keep[k] = _has_word(texts[k])
            parts[at] = pa.array(texts, parts[at].type)
            whole = pa.StructArray.from_arrays(parts, fields=list(row.type))
            yield pa.RecordBatch.from_arrays([whole, pa.array([bool(x) for x in hits], pa.bool_())],
                                             names=["_row", "_changed"]).filter(pa.array(keep))

    done, todo = None, docs
    while True:
        texts = todo.select(F.sha2(F.col("`text`").cast("binary"), 256).alias("_key"), F.col("`text`").alias("text"))
        hits = None
        for shared in shards:
            part = _hits_of_shard(texts, shared)
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hit"))
        rows = todo.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                           F.sha2(F.col("`text`").cast("binary"), 256).alias("_key"))
        joined = rows.join(hits, "_key", "left").select("_row", "hit")
        state = cut(joined.mapInArrow(run, f"_row {joined.schema['_row'].dataType.simpleString()}, _changed boolean"))
        kept = state.where("NOT _changed").select("_row.*")
        done = kept if done is None else done.unionByName(kept)
        todo = state.where("_changed").select("_row.*")
        if todo.isEmpty():
            return done
