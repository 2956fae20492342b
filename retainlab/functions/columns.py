"""Moments and exact order statistics of many numeric columns at once.

The columns come as one ``array<double>`` column.  Every pass is a map in which NumPy adds up a
task's rows, followed by a small shuffle of counts; no row is exploded or shuffled:

* :func:`moments`: rows, mean and sum of squared deviations by column;
* :func:`quantiles`: radix selection.  A double's bits, put in order, are read in three parts: two
  passes count the rows by the first 16 and the next 14 bits and keep the bins that hold a wanted
  position; the last one counts the distinct values that are left there.  A bin whose smallest and
  largest value agree is an answer, so a later pass reads only the columns still open.

NULL and NaN are missing values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: bits read by the two counting passes
HIGH, NEXT = 16, 14


def matrix(rows: pa.RecordBatch | pa.Array, d: int) -> np.ndarray:
    """The rows of a batch's first column, or of a column, as a matrix; NULL becomes NaN, -0 becomes 0."""
    return (rows.column(0) if isinstance(rows, pa.RecordBatch) else rows).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) + 0.0


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    bits = np.ascontiguousarray(x).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def merge(a: tuple, b: tuple) -> tuple:
    """(n, mean, m2) of two sets of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    delta = b[1] - a[1]
    return n, a[1] + delta * b[0] / n, a[2] + b[2] + delta * delta * a[0] * b[0] / n


def moments(df: DataFrame, values: Column, d: int) -> list[tuple]:
    """(n, mean, m2) of each of the ``d`` entries of ``values``: one small row a task and entry is collected."""
    return moments_by(df, F.lit(0), values, d).get(0, [(0, 0.0, 0.0)] * d)


def moments_by(df: DataFrame, key: Column, values: Column, d: int) -> dict[int | None, list[tuple]]:
    """:func:`moments` for each value of the int ``key``, of which there must be few, in the same single map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            X, keys = matrix(batch, d), batch.column(1)
            for k in keys.unique().to_pylist():
                total = totals.setdefault(k, [(0, 0.0, 0.0)] * d)
                mine = keys.is_null() if k is None else pc.fill_null(pc.equal(keys, k), False)
                rows = X[mine.to_numpy(zero_copy_only=False)]
                for j in range(d):
                    x = rows[:, j]
                    x = x[~np.isnan(x)]
                    if len(x):
                        by = x[0] if np.isfinite(x[0]) else 0.0
                        y = x - by  # a constant column has a deviation of exactly 0
                        m = y.mean()
                        total[j] = merge(total[j], (len(x), float(by + m), float(((y - m) ** 2).sum())))
        for k, total in totals.items():
            n, mean, m2 = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array([k] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(n, pa.int64()),
                                              pa.array(mean, pa.float64()), pa.array(m2, pa.float64())], names=["k", "j", "n", "mean", "m2"])

    out: dict = {}
    parts = df.select(values.alias("x"), key.cast("int").alias("k")).mapInArrow(run, "k int, j int, n long, mean double, m2 double")
    for r in sorted(parts.where("n > 0").collect(), key=lambda r: r[1:]):
        own = out.setdefault(r["k"], [(0, 0.0, 0.0)] * d)
        own[r["j"]] = merge(own[r["j"]], (r["n"], r["mean"], r["m2"]))
    return out


def _bins(df: DataFrame, d: int, slots: list[tuple[int, int | None]]) -> DataFrame:
    """(slot, bin, n, lo, hi): rows by the first bits of column j for a slot (j, None), by the next ones for
    (j, first bits), with the smallest and the largest value of the bin."""
    first = slots[0][1] is None
    size = 1 << (HIGH if first else NEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(slots), size), np.int64)
        low, top = np.full(seen.shape, np.inf), np.full(seen.shape, -np.inf)
        for batch in batches:
            X = np.sort(np.ascontiguousarray(matrix(batch, d).T), axis=1)  # NaN comes last
            known = X.shape[1] - np.isnan(X).sum(axis=1)
            for s, (j, at) in enumerate(slots):
                x = X[j, :known[j]]
                bits = ordered_bits(x)
                key = (bits >> np.uint64(64 - HIGH)).astype(np.int64)
                if at is not None:
                    own = slice(*np.searchsorted(key, [at, at + 1]))
                    x, key = x[own], ((bits[own] >> np.uint64(64 - HIGH - NEXT)) & np.uint64((1 << NEXT) - 1)).astype(np.int64)
                if not len(x):
                    continue
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                end, b = np.r_[start[1:], len(x)], key[start]
                seen[s, b] += end - start
                low[s, b] = np.minimum(low[s, b], x[start])
                top[s, b] = np.maximum(top[s, b], x[end - 1])
        s, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(b, pa.int64()), pa.array(seen[s, b], pa.int64()),
                                          pa.array(low[s, b]), pa.array(top[s, b])], names=["slot", "bin", "n", "lo", "hi"])

    parts = df.mapInArrow(run, "slot int, bin long, n long, lo double, hi double")
    return parts.groupBy("slot", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _left(df: DataFrame, d: int, slots: list[tuple[int, int]]) -> DataFrame:
    """(slot, bin, n, lo, hi): the values of column j whose first bits are a slot's, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            X = matrix(batch, d)
            ok = ~np.isnan(X)
            head = (ordered_bits(X) >> np.uint64(64 - HIGH - NEXT)).astype(np.int64)
            for s, (j, at) in enumerate(slots):
                value, n = np.unique(X[ok[:, j] & (head[:, j] == at), j], return_counts=True)
                if len(value):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), s), pa.int32()), pa.array(value),
                                                      pa.array(n, pa.int64())], names=["slot", "bin", "n"])

    counts = df.mapInArrow(run, "slot int, bin double, n long").groupBy("slot", "bin").agg(F.sum("n").alias("n"))
    return counts.select("*", F.col("bin").alias("lo"), F.col("bin").alias("hi"))


def _pick(counts: DataFrame, wanted: list[tuple[int, int]]) -> list[tuple]:
    """For each (slot, position) the bin that holds the position, the rows of the slot before that bin and its values' range."""
    spark = counts.sparkSession
    w = W.partitionBy("slot").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = counts.withColumn("cum", F.sum("n").over(w))
    at = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(wanted)], "i int, _s int, p long")
    holds = (F.col("slot") == F.col("_s")) & (F.col("cum") - F.col("n") <= F.col("p")) & (F.col("p") < F.col("cum"))
    rows = cum.join(F.broadcast(at), holds).select("i", "bin", (F.col("cum") - F.col("n")).alias("before"), "lo", "hi").collect()
    by = {r["i"]: (r["bin"], r["before"], r["lo"], r["hi"]) for r in rows}
    return [by[i] for i in range(len(wanted))]


def quantiles(df: DataFrame, values: Column, sizes: Sequence[int], qs: Sequence[float]) -> list[list[float | None]]:
    """Exact, linearly interpolated quantiles ``qs`` of each entry of ``values`` (None without values).

    ``sizes`` are the entries' numbers of values, as :func:`moments` gives them.
    """
    d, src = len(sizes), df.select(values.alias("x"))
    place = {(j, q): (n - 1) * q for j, n in enumerate(sizes) if n for q in qs}
    at: dict[tuple[int, int], float] = {}
    # (column, position) still wanted: bits known of the value, position among the rows that share them
    wanted = {x: (None, x[1]) for x in sorted({(j, int(f(p))) for (j, _), p in place.items() for f in (np.floor, np.ceil)})}
    for count in (_bins, _bins, _left):
        if not wanted:
            break
        cols = sorted({j for j, _ in wanted})
        few = src if len(cols) == d else src.select(F.array(*[F.col("x")[j] for j in cols]).alias("x"))
        slots = sorted({(cols.index(j), bits) for (j, _), (bits, _) in wanted.items()})
        found = _pick(count(few, len(cols), slots), [(slots.index((cols.index(j), bits)), p) for (j, _), (bits, p) in wanted.items()])
        left = {}
        for (x, (bits, p)), (b, before, lo, hi) in zip(wanted.items(), found):
            if lo == hi:
                at[x] = lo
            else:
                left[x] = (b if bits is None else (bits << NEXT) | b, p - before)
        wanted = left

    def value(j: int, q: float) -> float | None:
        if (j, q) not in place:
            return None
        p = place[j, q]
        lo, hi = at[j, int(np.floor(p))], at[j, int(np.ceil(p))]
        return lo + (hi - lo) * (p - np.floor(p))

    return [[value(j, q) for q in qs] for j in range(d)]
