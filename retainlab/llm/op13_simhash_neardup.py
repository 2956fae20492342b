"""SimHash near-dedup by meet-in-the-middle ball hashing.

1. ``fingerprints``: per whole text the XXH64 of every word shingle, repeats included; a fingerprint
   bit is the majority of that bit.
2. ``variants``: every distinct fingerprint emits all variants with at most half the radius of its
   bits flipped.  Two fingerprints at an even distance within the radius share such a variant.  An
   odd radius needs one more flip on one side: fingerprints at an odd distance differ in parity, so
   only those of odd parity emit the variants with one more flip.  At radius 3 those are pairs, and
   two of any three positions lie in the same half of the word, so pairs within a half are enough.
3. The variants are shuffled by one half of the word.  Those of a fingerprint that share it (561 of
   611 on average) travel as one row and are unfolded where they meet the others, so 50 rows a
   fingerprint are shuffled; a half that very many fingerprints share is dealt out to several tasks
   by the other half.
4. Every member of a variant that is within half the radius of it is within the radius of all
   others, so each is linked with the least such member and no pair of a group is missed; a last
   test counts the differing bits of each link.  Members are distinct fingerprints in a ball around
   the variant, so no group outgrows the ball (1,057 members at radius 3) and copies, however many,
   cost one row.
5. Linked fingerprints are contracted to components, which the documents join.

Edge cases: texts without a word (null and empty ones too) have fingerprint zero and are linked like
any other; a text with fewer words than a shingle is one shingle; equal rows share a fingerprint;
null ids are never a component id unless the component has no other (then it is null); empty tables
give empty results; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.llm.components import components
from retainlab.llm.runtime import cut, lean, look_up
from retainlab.llm.textwords import LOWER, column

SHINGLE, RADIUS, SEED = 3, 3, 42
#: shingles hashed before their bits are added up
STEP = 1 << 15
#: variants that a task unfolds at once, and of a shuffle partition
ROWS = 1 << 21
#: fingerprints that share half a word in one task
HOT = 4096


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    import xxhash

    words = raw.translate(LOWER.tobytes()).split()  # splits at \x20 and \x09 to \x0D
    if not words:
        return 0
    text = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    size = min(shingle, len(words))
    start, end = start[:len(words) - size + 1].tolist(), end[size - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(start), STEP):
        h = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(start[k:k + STEP], end[k:k + STEP])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed long."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py() or b"", shingle) for t in column(batch, "text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))],
                                             names=["doc_id", "fp"])

    src = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, family: int, odd: bool) -> np.ndarray:
    """The flips that a row of ``family`` unfolds to: half the radius, and one more for odd fingerprints of an odd radius.

    Family 0 flips bits of the lower half, family 1 of the upper one; family 1 exists for the wider flips only.
    """
    half, bits = radius // 2, range(32 * family, 32 * family + 32)
    weights = list(range(half + 1)) if family == 0 or not odd else []
    if odd and radius % 2:
        weights.append(half + 1)
    return np.array([sum(1 << i for i in own) for w in weights for own in combinations(bits, w)], np.uint64).view(np.int64)


def variants(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(family, m, fp): the variants of every distinct fingerprint, packed by the half of the word that is left alone.

    A row of family 0 (1) stands for the variants of ``fp`` that share the upper (lower) half of ``fp ^ m``: at ``m`` = 0
    those that flip bits of the other half (``masks``), else ``fp ^ m`` alone, one bit of the shared half flipped.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius from 0 to 3")
    odd = F.bit_count("fp") % 2 == 1
    zero = F.lit(0).cast("long")

    def flips(family: int) -> Column:
        shared = range(32, 64) if family == 0 else range(32)
        one = np.array([1 << i for i in shared], np.uint64).view(np.int64).tolist()
        return F.transform(F.lit(one), lambda m: F.struct(F.lit(family).cast("byte").alias("family"), m.alias("m")))

    def whole(family: int) -> Column:
        return F.array(F.struct(F.lit(family).cast("byte").alias("family"), zero.alias("m")))

    # single flips are within half the radius from 2 on; at 1 they are the wider flips of odd fingerprints
    rows = F.concat(whole(0), flips(0)) if radius >= 2 else F.when(odd, F.concat(whole(0), flips(0))).otherwise(whole(0)) \
        if radius == 1 else whole(0)
    if radius == 3:
        rows = F.concat(rows, F.when(odd, whole(1)).otherwise(F.concat(whole(1), flips(1))))
    return distinct.select(F.explode(rows).alias("e"), "fp").select("e.family", "e.m", "fp")


def _half(v: Column, family: Column) -> Column:
    """The half of a variant that its family shares."""
    return F.when(family == 0, F.shiftrightunsigned(v, 32)).otherwise(v.bitwiseAND(F.lit(0xFFFFFFFF)))


def _dealt(packed: DataFrame, parts: int) -> DataFrame:
    """(family, m, fp, part, parts) by shared half; a half of more than ``HOT`` unfolding rows is dealt out to several tasks.

    Each of those gets all unfolding rows and keeps the variants whose other half falls to it.
    """
    v = F.col("fp").bitwiseXOR(F.col("m"))
    keyed = packed.withColumn("half", _half(v, F.col("family")))
    hot = cut(keyed.where("m = 0").groupBy("family", "half").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT)
              .select("family", "half", F.ceil(F.col("_n") / HOT).cast("int").alias("parts")))
    if hot.isEmpty():
        out = keyed.withColumn("parts", F.lit(1)).withColumn("part", F.lit(0))
    else:
        own = F.pmod(_half(v, 1 - F.col("family")), F.col("parts")).cast("int")
        out = keyed.join(hot, ["family", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(
            "part", F.explode(F.when(F.col("m") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    return out.repartition(parts, "family", "half", "part").select("family", "m", "fp", "part", "parts")


def _leads(v: np.ndarray, fp: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Every member of a variant with the least member within half the radius of it, where there is one."""
    order = np.argsort(v, kind="stable")
    v, fp = v[order], fp[order]
    same = v[1:] == v[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    v, fp = v[shared], fp[shared]
    if not len(v):
        return v, fp
    begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    close = np.bitwise_count((v ^ fp).view(np.uint64)) <= half
    none = np.iinfo(np.int64).max
    size = np.diff(np.concatenate([begin, [len(v)]]))
    lead = np.repeat(np.minimum.reduceat(np.where(close, fp, none), begin), size)
    some = np.repeat(np.maximum.reduceat(close, begin), size)
    pick = some & (lead != fp)
    return fp[pick], lead[pick]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``radius`` of each other, each verified."""
    half = radius // 2
    table = {(family, odd): masks(radius, family, odd) for family in (0, 1) for odd in (False, True)}

    @lean
    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(column(b, c).to_numpy() for c in ("family", "m", "fp", "part", "parts")) for b in batches]
        if not rows:
            return
        family, m, fp, part, parts = (np.concatenate(x) for x in zip(*rows))
        del rows
        at = (fp ^ m).view(np.uint64)
        key = np.where(family == 0, at >> np.uint64(32), at & np.uint64(0xFFFFFFFF))
        order = np.lexsort((part, key, family))
        family, m, fp, part, parts, key = (x[order] for x in (family, m, fp, part, parts, key))
        odd = np.bitwise_count(fp.view(np.uint64)) % 2 == 1
        size = np.ones(len(fp), np.int64)
        for (f, o), flips in table.items():
            size[(m == 0) & (family == f) & (odd == o)] = len(flips)
        # whole halves, as many as unfold to about ROWS variants
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (family[1:] != family[:-1]) | (part[1:] != part[:-1])])
        group = np.concatenate([np.flatnonzero(new), [len(fp)]])
        total = np.concatenate([[0], np.cumsum(size)])[group]
        g = 0
        while g < len(group) - 1:
            h = max(g + 1, int(np.searchsorted(total, total[g] + ROWS, "right")) - 1)
            rows_of = slice(group[g], group[h])
            own, flip, fam, par, of, o = (x[rows_of] for x in (fp, m, family, part, parts, odd))
            vs, fs = [own[flip != 0] ^ flip[flip != 0]], [own[flip != 0]]
            for (f, is_odd), flips in table.items():
                k = (flip == 0) & (fam == f) & (o == is_odd)
                if k.any() and len(flips):
                    v = own[k][:, None] ^ flips
                    if (of[k] > 1).any():
                        other = v.view(np.uint64) & np.uint64(0xFFFFFFFF) if f == 0 else v.view(np.uint64) >> np.uint64(32)
                        mine = other % of[k][:, None].astype(np.uint64) == par[k][:, None].astype(np.uint64)
                        vs.append(v[mine])
                        fs.append(np.broadcast_to(own[k][:, None], v.shape)[mine])
                    else:
                        vs.append(v.ravel())
                        fs.append(np.repeat(own[k], len(flips)))
            a, b = _leads(np.concatenate(vs), np.concatenate(fs), half)
            for i in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[i:i + (1 << 16)]), pa.array(b[i:i + (1 << 16)])], names=["a", "b"])
            g = h

    sizes = {key: len(flips) for key, flips in table.items()}
    odd = F.bit_count("fp") % 2 == 1
    emitted = int(distinct.select(F.sum(F.when(odd, sizes[0, True] + sizes[1, True]).otherwise(sizes[0, False] + sizes[1, False])))
                  .first()[0] or 0)
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-emitted // ROWS))
    met = _dealt(variants(distinct, radius), parts).mapInArrow(collide, "a long, b long")
    return (met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fp (signed long), component_id, the least id reachable through links."""
    drawn = cut(fingerprints(docs, shingle))
    distinct = cut(drawn.groupBy("fp").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("rows")))
    label = components(cut(links(distinct.select("fp"), radius)))
    own = cut(distinct.join(label, F.col("fp") == F.col("node"), "left")
              .select("fp", "min_id", "rows", F.coalesce("root", "fp").alias("root")))
    least = own.groupBy("root").agg(F.min("min_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    ids = cut(look_up(own, least, "root", "_n").select("fp", "component_id", "rows"))
    return look_up(drawn, ids, "fp", "rows").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 lowercase hex digits, and the component."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
