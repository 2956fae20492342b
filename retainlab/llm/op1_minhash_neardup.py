"""MinHash near-dedup by a multi-index Hamming join.

1. ``sketch``: the distinct word shingles of every whole text, a 64-bit key of the set
   and a signature of ``K`` symbols of 16 bits (one per min-wise hash).  Equal sets form
   a class, so copies cost one row.
2. ``buckets``: the signature is split into chunks of four symbols.  By pigeonhole two
   signatures that differ in at most ``2 * chunks - 1`` symbols agree in some chunk but
   for one symbol, so each chunk is indexed four times with one symbol left out.  The
   number of chunks is the least for which a pair at the similarity threshold exceeds
   that distance with probability below ``MISS``.
3. Links are found without pairing a whole bucket.  ``star_pairs`` compares members with
   the least member, ``confirm`` counts the common shingles of their whole sets, and
   confirmed links are contracted to components.
4. In the buckets that still span several components, ``cross_links`` compares the
   signatures of members of different components, in blocks of bounded size.  A first
   pass returns the members that have such a pair under the signature distance (each
   pair counts in one bucket only); a second one gets their whole sets, confirms the
   pairs where they are found, nearest first, and skips those that confirmed links
   connect already.  Candidate pairs are never rows, so a large group of copies costs
   rows in proportion to its members.  Every pair under the distance is thus confirmed,
   refuted, or already connected.

Edge cases: null and empty texts (or texts without a word) have no shingle and link with
nothing; a text with fewer words than a shingle is one shingle; equal rows share a class;
null ids are never a component id unless the component has no other (then it is null);
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.llm.components import components
from retainlab.llm.runtime import cut, lean
from retainlab.llm.textwords import (SPACE_SPLIT, U, column, mix, ngram_hashes, slices, window_starts, word_hashes,
                                     words)

SYMBOLS = 4          # symbols of a chunk, one of which may differ
MISS = 1e-6          # chance that a pair at the threshold is beyond the signature distance
BLOCK = 1024         # members of a bucket that one task compares with as many others
PAIR_SLICE = 1 << 14  # pairs that are walked at once
SET_BLOCK = 256      # members that are confirmed against one least member together


def chunks_for(num: int, den: int) -> int:
    """Least number of chunks whose guaranteed distance covers a pair of similarity num/den."""
    p = 1 - num / den
    for m in range(2, 31):
        k = SYMBOLS * m
        if sum(comb(k, i) * p ** i * (1 - p) ** (k - i) for i in range(2 * m, k + 1)) <= MISS:
            return m
    raise ValueError("similarity threshold too low for this index")


def shingle_sets(h: np.ndarray, woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text of a slice, one text after another, and their ranges."""
    g = ngram_hashes(h, n)
    starts = window_starts(woff, n)
    g = g[starts]
    count = np.maximum(np.diff(woff) - n + 1, 0)
    short = np.flatnonzero((np.diff(woff) > 0) & (count == 0))
    if len(short):
        whole = [ngram_hashes(h[woff[k]:woff[k + 1]], int(woff[k + 1] - woff[k]))[0] for k in short]
        g = np.insert(g, np.cumsum(count)[short], np.array(whole, np.uint64))
        count[short] = 1
    return g, np.concatenate([[0], np.cumsum(count)])


def _distinct(g: np.ndarray) -> np.ndarray:
    g = np.sort(g)
    return g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g


def sketch(docs: DataFrame, shingle: int, chunks: int) -> DataFrame:
    """(doc_id, _t, n_shingles, cls, sig); cls and sig are null for an empty set; _t hashes the text."""
    size = SYMBOLS * chunks

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, size + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        odd = mix(salt) | U(1)
        for batch in batches:
            for first, last, buf, off in slices(column(batch, "text")):
                s, e, woff = words(buf, off, SPACE_SPLIT)
                g, at = shingle_sets(word_hashes(buf, s, e), woff, shingle)
                n = np.zeros(last - first, np.int64)
                cls: list[int | None] = [None] * (last - first)
                for k in range(last - first):
                    if at[k] < at[k + 1]:
                        own = _distinct(g[at[k]:at[k + 1]])
                        n[k] = len(own)
                        cls[k] = int(mix(mix(own).sum(keepdims=True) + U(len(own)))[0].astype(np.int64))
                full = np.flatnonzero(n)
                sig = np.empty((len(full), size), np.uint64)
                for j in range(size):
                    if len(full):
                        sig[:, j] = np.minimum.reduceat((g ^ salt[j]) * odd[j], at[:-1][full])
                sig = mix(sig) & U(0xFFFF)
                sig_list: list = [None] * (last - first)
                for i, k in enumerate(full):
                    sig_list[k] = sig[i].astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").slice(first, last - first), column(batch, "_t").slice(first, last - first),
                     pa.array(n), pa.array(cls, pa.int64()), pa.array(sig_list, pa.binary())],
                    names=["doc_id", "_t", "n_shingles", "cls", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("_t")).mapInArrow(
        run, "doc_id long, _t long, n_shingles long, cls long, sig binary")


def bucket_keys(sig: str, chunks: int) -> Column:
    """The index keys of a signature: slot (chunk, symbol left out) in the top 16 bits, the chunk's other symbols below."""
    keys = []
    for c in range(chunks):
        at = 2 * SYMBOLS * c + 1
        for k in range(SYMBOLS):
            rest = F.concat(F.substring(sig, at, 2 * k), F.substring(sig, at + 2 * k + 2, 2 * (SYMBOLS - 1 - k)))
            keys.append(F.conv(F.hex(rest), 16, 10).cast("long") + F.lit(c * SYMBOLS + k << 48))
    return F.array(*keys)


def buckets(classes: DataFrame, chunks: int) -> DataFrame:
    """(key, cls, lead, size): members of index buckets with at least two classes, and the least member."""
    member = classes.select(F.explode(bucket_keys("sig", chunks)).alias("key"), "cls")
    lead = member.groupBy("key").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return member.join(lead, "key")


def star_pairs(bucket: DataFrame) -> DataFrame:
    """(g, i, a, b): every member b and the least one a, in groups (g = a, i) of about SET_BLOCK."""
    pairs = bucket.where("cls != lead").groupBy("lead", "cls").agg(F.max("size").alias("size"))
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / SET_BLOCK)).cast("int")
    return pairs.select(F.col("lead").alias("g"), part.alias("i"), F.col("lead").alias("a"), F.col("cls").alias("b"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def under_distance(pairs: DataFrame, classes: DataFrame, radius: int, num: int, den: int) -> DataFrame:
    """``pairs`` with d, the number of differing symbols, where d <= ``radius`` and the sizes allow the threshold."""
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        x, y = (np.frombuffer(b"".join(v), "<u2").reshape(len(v), -1) for v in (a, b))
        return pd.Series(_distance(x, y))

    one = classes.select(F.col("cls").alias("a"), F.col("sig").alias("_sa"), F.col("n_shingles").alias("_na"))
    two = classes.select(F.col("cls").alias("b"), F.col("sig").alias("_sb"), F.col("n_shingles").alias("_nb"))
    sizes = F.least("_na", "_nb") * den >= F.greatest("_na", "_nb") * num
    return (pairs.join(one, "a").join(two, "b").where(sizes).select(*pairs.columns, distance("_sa", "_sb").alias("d"))
            .where(F.col("d") <= radius))


def _first_bucket(same: np.ndarray) -> np.ndarray:
    """Number of the first index bucket that two signatures share; ``same``: equal symbols, one row a pair."""
    chunk = same.reshape(len(same), same.shape[1] // SYMBOLS, SYMBOLS)
    c = (chunk.sum(axis=2) >= SYMBOLS - 1).argmax(axis=1)
    own = chunk[np.arange(len(same)), c]
    return c * SYMBOLS + np.where(own.all(axis=1), 0, own.argmin(axis=1))


def _block_pairs(group: pa.Table, radius: int, num: int, den: int) -> np.ndarray:
    """Row numbers and distance (3, n) of the pairs of a block pair that are under the signature distance.

    Only pairs of different components whose sizes allow the threshold, and whose first common bucket this is.
    """
    n, comp, block = (group.column(c).to_numpy() for c in ("n_shingles", "comp", "block"))
    slot = group.column("g")[0].as_py() >> 48
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(n), -1)
    across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    order = np.argsort(n, kind="stable")
    top = np.searchsorted(n[order] * num, n[order] * den, "right")  # sizes within the threshold
    out = [np.zeros((3, 0), np.int16)]  # blocks hold far fewer than 2 ** 15 members
    for i, k in enumerate(order):
        rest = order[i + 1:top[i]]
        rest = rest[(comp[rest] != comp[k]) & ((block[rest] != block[k]) if across else True)]
        same = sig[rest] == sig[k]
        d = same.shape[1] - same.sum(axis=1)
        near = d <= radius
        near[near] = _first_bucket(same[near]) == slot
        out.append(np.stack([np.full(near.sum(), k), rest[near], d[near]]).astype(np.int16))
    return np.concatenate(out, axis=1)


def cross_links(bucket: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, member: DataFrame, shingle: int,
                radius: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within buckets between different components, enough of them to connect all linked classes.

    ``labels``: (cls, comp), one row per class of ``bucket``.  The least member is left out (``star_pairs`` has its
    pairs).  A bucket of more than ``BLOCK`` members is dealt out as pairs of blocks, so a task holds two blocks at most.
    """
    inside = bucket.where("size > 2").join(labels, "cls")
    mixed = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    inside = (inside.join(mixed.select("key"), "key", "left_semi").where("cls != lead")
              .join(classes.select("cls", "sig", "n_shingles"), "cls"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = inside.select(F.col("key").alias("g"), "cls", "comp", "sig", "n_shingles",
                          F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_o"))
    dealt = dealt.select("g", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"),
                         "cls", "comp", "sig", "n_shingles", "block")

    def paired(group: pa.Table) -> pa.Table:
        return group.take(np.unique(_block_pairs(group, radius, num, den)[:2]))

    def check(group: pa.Table) -> pa.Table:
        found = _block_pairs(group, radius, num, den)
        return _confirmed(group, found[:2, np.argsort(found[2], kind="stable")], shingle, num, den)

    kept = cut(dealt.groupBy("g", "i", "j").applyInArrow(paired, dealt.schema))
    return with_texts(kept, docs, member).groupBy("g", "i", "j").applyInArrow(check, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    z = np.sort(np.concatenate([x, y]))
    return int((z[1:] == z[:-1]).sum())


def whole_sets(texts: pa.ChunkedArray, shingle: int) -> list[np.ndarray]:
    """The sorted shingle hashes of every text."""
    out: list[np.ndarray] = []
    for first, last, buf, off in slices(texts):
        s, e, woff = words(buf, off, SPACE_SPLIT)
        g, begin = shingle_sets(word_hashes(buf, s, e), woff, shingle)
        out += [_distinct(g[begin[k]:begin[k + 1]]) for k in range(last - first)]
    return out


def _confirmed(group: pa.Table, pairs: np.ndarray, shingle: int, num: int, den: int) -> pa.Table:
    """The pairs of row numbers that are linked on whole sets, without those connected by earlier ones.

    Pairs are walked in slices; those that earlier slices have connected are dropped before the next one.
    """
    own, cls = whole_sets(group.column("text"), shingle), group.column("cls").to_numpy()
    top = np.arange(len(cls))
    links = []
    for at in range(0, pairs.shape[1], PAIR_SLICE):
        while (top[top] != top).any():
            top = top[top]
        part = pairs[:, at:at + PAIR_SLICE]
        part = part[:, top[part[0]] != top[part[1]]]
        for a, b in zip(part[0], part[1]):
            p, q = _root(top, a), _root(top, b)
            if p != q:
                x, y = own[a], own[b]
                n = _common(x, y)
                if n * den >= (len(x) + len(y) - n) * num:
                    top[p] = q
                    links.append((cls[a], cls[b]))
    cols = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": cols[:, 0], "b": cols[:, 1]})


def _root(top: np.ndarray, x: int) -> int:
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def with_texts(need: DataFrame, docs: DataFrame, member: DataFrame) -> DataFrame:
    """``need`` with the text of one document of each row's class (cls).

    ``member``: (cls, doc_id, _t: hash of the text) names that document.  Rows of ``docs`` are found by one hash of id
    and text; the search, the removal of repeated rows and the join share its partitioning, so texts are dealt out once.
    """
    own = member.select(F.col("cls").alias("_c"), F.xxhash64("doc_id", "_t").alias("_row"))
    asked = need.join(own, F.col("cls") == F.col("_c")).drop("_c")
    rows = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("_row"), "text")
    texts = rows.join(asked.select("_row").distinct(), "_row", "left_semi").dropDuplicates(["_row"])
    return asked.join(texts, "_row").drop("_row")


def confirm(pairs: DataFrame, docs: DataFrame, member: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among star pairs (g, i, a, b, d), materialised: den * common >= num * united on whole sets.

    The texts of a group's classes are sent to its task once, the least member's among them.
    """
    need = pairs.select("g", "i", F.explode(F.array("a", "b")).alias("cls")).distinct()

    def check(group: pa.Table) -> pa.Table:
        cls = group.column("cls").to_numpy()
        lead = int(np.flatnonzero(cls == group.column("g")[0].as_py())[0])
        rest = np.flatnonzero(np.arange(len(cls)) != lead)
        return _confirmed(group, np.stack([np.full(len(rest), lead), rest]), shingle, num, den)

    return with_texts(need, docs, member).groupBy("g", "i").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, text_key (xxhash64 of the text), component_id, kept (see the module text).

    ``num / den`` is the least linked similarity.  Rows of equal doc_id and different text are different documents.
    """
    chunks = chunks_for(num, den)
    radius = 2 * chunks - 1
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    drawn = cut(sketch(docs, shingle, chunks))
    classes = cut(drawn.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "_t")).alias("rep"),
        F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    member = classes.select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep._t").alias("_t"))
    bucket = cut(buckets(classes, chunks))

    near = cut(under_distance(star_pairs(bucket), classes, radius, num, den))
    links = cut(confirm(near, docs, member, shingle, num, den))
    label = components(links)

    labels = bucket.select("cls").distinct().join(label, F.col("cls") == F.col("node"), "left").select(
        "cls", F.coalesce("root", "cls").alias("comp"))
    more = cross_links(bucket, labels, classes, docs, member, shingle, radius, num, den)
    label = components(links.unionByName(more))
    own = classes.select("cls", "min_id").join(label, F.col("cls") == F.col("node"))
    least = own.groupBy("root").agg(F.min("min_id").alias("least_id"))
    moved = own.join(least, "root").select("cls", "least_id")
    ids = classes.select("cls", "min_id").join(moved, "cls", "left").select(
        "cls", F.coalesce("least_id", "min_id").alias("component_id"))
    out = drawn.select("doc_id", "_t", "n_shingles", "cls").join(ids, "cls", "left").select(
        "doc_id", "n_shingles", F.col("_t").alias("text_key"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
