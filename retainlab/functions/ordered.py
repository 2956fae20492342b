"""Distributed order statistics without a single-partition window.

Running sums and ranks over a *global* order are the classic trap: a
``Window.orderBy`` without ``partitionBy`` pulls every row into one task.
Every helper here cuts the order into contiguous buckets, computes local
running values per bucket with a window partitioned by the bucket, and adds
per-bucket offsets from a small table (one row per bucket and group, so its
size is bounded by the bucket count we choose).

Bucket ids must be *deterministic*: the same row must land in the same bucket
in the pass that computes local values and in the pass that computes bucket
totals, even when a stage is recomputed after an executor loss.  So buckets
are never taken from ``spark_partition_id`` of a sampled range exchange:

* hash-ordered keys (seeded shuffles) use a prefix of the hash itself;
* numeric keys use boundaries computed once (``approxQuantile``, collected as
  a bounded list) and applied with ``Bucketizer`` (a binary search in the JVM);
* arbitrary orders (:func:`row_index`) materialise the range-partitioned rows
  once with a reliable ``checkpoint`` in the shared checkpoint folder.

Callers pre-aggregate to distinct keys where values repeat, so a value held
by a third of all rows is one row here, not a hot bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retainlab.session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1

# Upper bound on buckets: offset tables have at most this many rows per group.
MAX_BUCKETS = 65536
# Hex digits of a hash prefix used as bucket (16**4 = 65536 buckets).
HASH_DIGITS = 4


def has_repeats(df: DataFrame, key: str) -> bool:
    """Whether a value of ``key`` (null like any other) is in more than one row."""
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()


def _num_buckets(df: DataFrame, n: int | None) -> int:
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(int(n), MAX_BUCKETS))


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _offsets(local: DataFrame, bucket: str, group: Sequence[str], values: dict[str, Column],
             broadcast: bool) -> DataFrame:
    """Join exclusive per-bucket offsets of ``values`` (within ``group``) onto ``local``."""
    totals = local.groupBy(*group, bucket).agg(*[F.sum(v).alias(f"_tot_{k}") for k, v in values.items()])
    # one row per (group, bucket): small by construction
    wo = (W.partitionBy(*group).orderBy(bucket) if group else W.orderBy(bucket)) \
        .rowsBetween(W.unboundedPreceding, -1)
    # fresh names on the small side: it derives from ``local`` (self-join)
    offsets = totals.select(*[F.col(g).alias(f"_og{i}") for i, g in enumerate(group)],
                            F.col(bucket).alias("_ob"), *[
        F.coalesce(F.sum(f"_tot_{k}").over(wo), F.lit(0)).alias(f"_off_{k}") for k in values])
    cond = F.col(bucket) == F.col("_ob")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_og{i}"))
    right = F.broadcast(offsets) if broadcast else offsets
    joined = local.join(right, cond)
    return joined.select(*[F.col(c) for c in local.columns], *[F.col(f"_off_{k}") for k in values])


def hash_rank(df: DataFrame, group: Sequence[str], hex_key: str, tiebreak: str,
              name: str = "rank", digits: int = HASH_DIGITS, groups_bounded: bool = True) -> DataFrame:
    """0-based rank inside ``group`` ordered by (``hex_key``, ``tiebreak``).

    ``hex_key`` is a lowercase hex digest (uniform), so its first ``digits``
    characters split every group into 16**digits balanced, order-preserving
    buckets.  Adds ``name`` and ``{name}_group_size``.  The offsets table has
    #groups x 16**digits rows; it is broadcast only when the caller vouches
    that the groups are few (``groups_bounded``, e.g. a binary label: 2 x
    65,536 rows, about 3 MB), otherwise joined by a shuffle.
    """
    bk = F.conv(F.substring(F.col(hex_key), 1, digits), 16, 10).cast("int")
    b = df.withColumn("_bk", bk)
    wl = W.partitionBy(*group, "_bk").orderBy(hex_key, tiebreak)
    local = b.withColumn("_loc", F.row_number().over(wl) - 1)
    small = groups_bounded
    with_off = _offsets(local, "_bk", group, {"n": F.lit(1)}, small)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(f"{name}_group_size")) \
        .select(*[F.col(g).alias(f"_sg{i}") for i, g in enumerate(group)], f"{name}_group_size")
    cond = None
    for i, g in enumerate(group):
        c = F.col(g).eqNullSafe(F.col(f"_sg{i}"))
        cond = c if cond is None else cond & c
    out = with_off.join(F.broadcast(sizes) if small else sizes, cond) if group \
        else with_off.join(sizes, how="inner")
    return out.select(*[F.col(c) for c in df.columns],
                      (F.col("_off_n") + F.col("_loc")).alias(name), F.col(f"{name}_group_size"))


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_index",
              num_buckets: int | None = None) -> DataFrame:
    """0-based global position of each row in ``order`` (must be a total order).

    Rows are range-partitioned and sorted once, stamped with
    ``monotonically_increasing_id`` (partition index in the high bits, position
    in the low bits) and checkpointed to the shared folder, so both uses below
    read the same stamped rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = _num_buckets(df, num_buckets)
    keys = _cols(order)
    stamped = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) \
        .withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    ranged = stamped.withColumn("_bk", F.shiftright("_mid", 33)) \
        .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    # offsets: one row per range partition (<= n), broadcast is bounded by n.
    out = _offsets(ranged, "_bk", [], {"n": F.lit(1)}, True)
    return out.select(*[F.col(c) for c in df.columns], (F.col("_off_n") + F.col("_loc")).alias(name))


def numeric_buckets(df: DataFrame, col: str, n: int, out: str = "_bk") -> DataFrame:
    """Order-preserving bucket id of a numeric column from approximate quantiles.

    The boundaries are computed once and passed to ``Bucketizer`` as literals,
    so every later pass assigns identical buckets.
    """
    qs = df.approxQuantile(col, [i / n for i in range(1, n)], 1.0 / (4 * n)) if n > 1 else []
    inner = sorted({float(q) for q in qs if q == q and q not in (float("inf"), float("-inf"))})
    # without boundaries (empty, all null, one bucket) any single one will do
    splits = [float("-inf"), *(inner or [0.0]), float("inf")]
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep")
    return b.transform(df)


def prefix_sums(df: DataFrame, order: str, values: Sequence[str], group: Sequence[str] = (),
                prefix: str = "cum_", num_buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` within ``group`` along numeric ``order``.

    ``group + order`` should identify rows (callers aggregate to distinct keys
    first); ties in ``order`` inside a group are summed in arbitrary order.
    """
    n = _num_buckets(df, num_buckets)
    b = numeric_buckets(df, order, n)
    wl = W.partitionBy(*group, "_bk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = b.select("*", *[F.sum(v).over(wl).alias(f"_loc_{v}") for v in values])
    with_off = _offsets(local, "_bk", group, {v: F.col(v) for v in values}, not group)
    return with_off.select(*[F.col(c) for c in df.columns], *[
        (F.col(f"_loc_{v}") + F.col(f"_off_{v}")).alias(f"{prefix}{v}") for v in values])


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5,
                    num_buckets: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantile of each column (NULLs skipped).

    Returns ``(column STRING, value DOUBLE, n BIGINT)``.  Values are counted
    per (column, value) with map-side partial aggregation (a hot value
    collapses to one row), ranked with :func:`prefix_sums`, and only the one
    or two rows straddling the target position are kept.
    """
    if not cols:
        raise ValueError("no columns")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    # read three times below (sketch, running sums, totals): materialise the
    # distinct-value table once in the shared folder instead of re-deriving the input
    ensure_checkpoint_dir(df.sparkSession)
    counts = counts.checkpoint(eager=True)
    ranked = prefix_sums(counts, "value", ["cnt"], group=["column"], num_buckets=num_buckets)
    n = counts.groupBy("column").agg(F.sum("cnt").alias("n"))
    pos = (F.col("n") - 1) * F.lit(q)
    lo, hi = F.floor(pos), F.ceil(pos)
    first = F.col("cum_cnt") - F.col("cnt")  # index of the first copy of this value
    cover = lambda i: (first <= i) & (i < F.col("cum_cnt"))
    j = ranked.join(n, "column")
    picked = j.where(cover(lo) | cover(hi)).select(
        "column", "n", pos.alias("pos"),
        F.when(cover(lo), F.col("value")).alias("v_lo"),
        F.when(cover(hi), F.col("value")).alias("v_hi"))
    res = picked.groupBy("column", "n", "pos").agg(F.max("v_lo").alias("v_lo"),
                                                     F.max("v_hi").alias("v_hi"))
    val = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.floor("pos"))
    return res.select("column", val.alias("value"), "n")


def exact_quantile_table(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                         num_buckets: int | None = None) -> DataFrame:
    """Several exact, linearly interpolated quantiles of each column: ``(column, q, value)``.

    The counted values are ranked once for all quantiles (see :func:`exact_quantiles`).
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    ensure_checkpoint_dir(df.sparkSession)
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")).checkpoint(eager=True)
    ranked = prefix_sums(counts, "value", ["cnt"], group=["column"], num_buckets=num_buckets)
    wanted = counts.groupBy("column").agg(F.sum("cnt").alias("n")).select(
        F.col("column").alias("_c"), "n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).select(
        "_c", "q", ((F.col("n") - 1) * F.col("q")).alias("pos"))
    first = F.col("cum_cnt") - F.col("cnt")
    lo, hi = F.floor("pos"), F.ceil("pos")
    meets = (F.col("column") == F.col("_c")) & (first <= hi) & (lo < F.col("cum_cnt"))
    # ``wanted`` has one row per column and quantile
    picked = ranked.join(F.broadcast(wanted), meets).groupBy("column", "q", "pos").agg(
        F.min("value").alias("v_lo"), F.max("value").alias("v_hi"))
    value = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.floor("pos"))
    return picked.select("column", "q", value.alias("value"))
