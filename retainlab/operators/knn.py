"""Exact k-nearest-neighbour classification (M6 / J4) in one map pass over the queries.

The training rows are the model, all of them: up to ``HELD`` rows are a matrix that is
broadcast, more are a Parquet table in the shared folder that every task reads block by
block (through PyArrow), so neither the driver nor a task ever holds them.  ``max_fit``
is an optional bound on labelled rows, off unless set; a larger training set is then
represented by its ``max_fit`` rows of smallest seeded hash.  Every query row is compared
with all blocks inside one task: no pair becomes a row, queries are shuffled only from a table
of fewer partitions than twice the cores, and a task holds some queries with their running neighbours and one block of training rows.

Neighbours are exact: products of the first principal coordinates (of the first block; any
orthonormal ones would do) give lower bounds of the distances and only leave out rows beyond
the running k-th distance (with a margin for rounding); the others are measured from the
coordinate differences, and ties go to the smaller id.  The work stays queries times rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainlab.operators.persist import StateWritable
from retainlab.session import shared_path

#: most training rows held as a broadcast matrix (78 doubles a row: about 60 MB); more are read from a table
HELD = 100_000
#: training rows compared at once with ``QUERY_BLOCK`` queries; queries for which the table is read once
TRAIN_BLOCK, QUERY_BLOCK, QUERIES = 1024, 256, 16_384
#: principal coordinates that rows are left out by; pairs measured at once
COORDINATES, PAIRS = 32, 1 << 16
#: hex digits of the hash prefix that rows beyond maxFit are left out by (65,536 prefixes)
HASH_DIGITS = 4
#: position of a neighbour not found
NONE = np.iinfo(np.int64).max


class _KNNParams(Params):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "row id, breaks ties", TypeConverters.toString)
    maxFit = Param(Params._dummy(), "maxFit", "most labelled rows of the model (0: all)", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the choice of rows beyond maxFit", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(k=5, idCol="student_id", maxFit=0, seed=42)


class KNNClassifier(Estimator, _KNNParams):
    @keyword_only
    def __init__(self, k: int = 5, idCol: str = "student_id", maxFit: int = 0, seed: int = 42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "KNNModel":
        g = self.getOrDefault
        rows = df.select(F.col(g("idCol")).cast("string").alias("tid"), vector_to_array("features").alias("x"),
                         F.col("label").cast("double").alias("y"))
        if g("maxFit"):
            rows = self._bounded(rows)
        model = KNNModel()
        model._set(k=g("k"), idCol=g("idCol"), maxFit=g("maxFit"), seed=g("seed"))
        if rows.count() <= HELD:
            model._take(rows.toArrow())
        else:
            path = shared_path(df.sparkSession, f"tables/{uuid.uuid4().hex}")
            # ids in order get positions in order
            _write(rows.orderBy("tid").select(F.monotonically_increasing_id().alias("pos"), "*"), path)
            model._read(df.sparkSession, path)
        return model

    def _bounded(self, rows: DataFrame) -> DataFrame:
        """The rows of smallest hash: hash prefixes that cannot be among them are left out first, or every
        task would send the driver its best maxFit rows."""
        g = self.getOrDefault
        key = F.md5(F.concat("tid", F.lit(f"#{g('seed')}")))
        prefix = F.substring(key, 1, HASH_DIGITS)
        seen, last = 0, None
        for r in rows.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
            seen, last = seen + r["n"], r["p"]
            if seen >= g("maxFit"):
                rows = rows.where(prefix.isNull() | (prefix <= F.lit(last)) if last is not None else prefix.isNull())
                break
        return rows.orderBy(key, "tid").limit(g("maxFit"))


def _write(rows: DataFrame, path: str) -> None:
    # small row groups: a task that reads the table holds one
    rows.write.option("parquet.enable.dictionary", "false").option("parquet.block.size", str(16 << 20)).parquet(path)


def _pairs(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the true entries, of which there are few."""
    flat = near.ravel()
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:  # eight entries at a time
        words = np.flatnonzero(flat.view(np.uint64))
        w, b = np.nonzero(flat.reshape(-1, 8)[words])
        at = words[w] * 8 + b
    return np.divmod(at, near.shape[1])


class _Bounds:
    """Lower bounds of squared distances from the first principal coordinates."""

    def __init__(self, X: np.ndarray):
        known = X[np.isfinite(X).all(axis=1)]
        d = X.shape[1]
        self.centre, self.axes = np.zeros(d), np.eye(d)
        if len(known) > 1 and np.abs(known).max(initial=0.0) < 1e100:
            self.centre = known.mean(axis=0)
            self.axes = np.linalg.eigh(np.cov(known, rowvar=False).reshape(d, d))[1][:, ::-1]
        self.axes = self.axes[:, :COORDINATES]

    def of(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates, their sums of squares and the largest one in size."""
        with np.errstate(invalid="ignore", over="ignore"):
            C = (X - self.centre) @ self.axes
            return C, (C * C).sum(axis=1), float(np.fmax.reduce(np.abs(C), axis=None, initial=0.0))

    def near(self, q: tuple, x: tuple, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) that may be within the queries' ``limit``."""
        kind, unit = (np.float32, 2.0 ** -23) if max(q[2], x[2]) < 1e15 else (np.float64, 2.0 ** -52)
        # rounding changes a product by less than this share of the two sums of squares
        share = (len(self.axes) + self.axes.shape[1] + 10) * unit
        left = np.concatenate([q[0], np.ones((len(q[0]), 1))], axis=1).astype(kind)
        right = np.concatenate([-2.0 * x[0], ((1.0 - share) * x[1])[:, None]], axis=1).astype(kind)
        most = (limit - (1.0 - share) * q[1] + share * (limit + q[1]) + 1e-30).astype(kind)
        return _pairs(left @ right.T <= most[:, None])


def search(Q: np.ndarray, blocks: Iterable[tuple], k: int) -> tuple[np.ndarray, ...]:
    """Squared distance, position and further columns of the ``k`` nearest rows of every query, by distance and position.

    ``blocks`` holds (positions, rows, further columns ...); a neighbour that is missing has the position ``NONE``.
    """
    n, out, bounds, q = len(Q), None, None, {}
    qq = (Q * Q).sum(axis=1)
    for pos, X, *more in blocks:
        if not len(X):
            continue
        if out is None:
            out = [np.full((n, k), np.inf), np.full((n, k), NONE), *[np.zeros((n, k), m.dtype) for m in more]]
            bounds = _Bounds(X)
            q = {at: bounds.of(Q[at:at + QUERY_BLOCK]) for at in range(0, n, QUERY_BLOCK)}
        x = bounds.of(X)
        for at in q:
            own = slice(at, min(at + QUERY_BLOCK, n))
            limit = out[0][own, k - 1]
            if np.isinf(limit).any():
                i, j = _first(Q[own], qq[own], X, k)
            else:
                i, j = bounds.near(q[at], x, limit)
            for part in range(0, len(i), PAIRS):
                _closer(out, Q, X, i[part:part + PAIRS] + at, j[part:part + PAIRS], (pos, *more), k)
    return tuple(out) if out else (np.full((n, k), np.inf), np.full((n, k), NONE))


def _first(Q: np.ndarray, qq: np.ndarray, X: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of a block that may be among its ``k`` nearest rows, for queries without ``k`` neighbours yet."""
    xx = (X * X).sum(axis=1)
    d = qq[:, None] + xx[None] - 2.0 * (Q @ X.T)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= len(X) else np.full(len(Q), np.inf)
    margin = 1e-9 * (qq + np.fmax.reduce(xx, initial=0.0) + 1.0)
    return _pairs(~(d > (kth + margin)[:, None]) & ~np.isnan(xx) & ~np.isnan(qq)[:, None])


def _closer(out: list[np.ndarray], Q: np.ndarray, X: np.ndarray, i: np.ndarray, j: np.ndarray, columns: tuple, k: int) -> None:
    """Measures the pairs and puts the rows that are closer in the queries' places of ``out``."""
    diff = Q[i] - X[j]
    d = (diff * diff).sum(1)
    keep = d <= out[0][i, k - 1]
    if not keep.any():
        return
    i, j, d = i[keep], j[keep], d[keep]
    mine = np.unique(i)
    who = np.concatenate([np.repeat(mine, k), i])
    all_ = [np.concatenate([o[mine].ravel(), v]) for o, v in zip(out, (d, *[c[j] for c in columns]))]
    order = np.lexsort((all_[1], all_[0], who))
    best = order[np.searchsorted(who[order], mine)[:, None] + np.arange(k)]
    for o, v in zip(out, all_):
        o[mine] = v[best]


def held_blocks(X: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    for at in range(0, len(X), TRAIN_BLOCK):
        own = slice(at, min(at + TRAIN_BLOCK, len(X)))
        yield np.arange(own.start, own.stop), X[own], *[m[own] for m in more]


def table_blocks(files: list[str], *more: str) -> Iterator[tuple]:
    """The blocks of a table of training rows, read by the task itself."""
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for rows in pq.ParquetFile(f).iter_batches(TRAIN_BLOCK, columns=["pos", "x", *more]):
                by = {c: rows.column(c) for c in rows.schema.names}
                if rows.num_rows:
                    x = by["x"].flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                    yield by["pos"].to_numpy(), x, *[by[c].to_numpy(zero_copy_only=False) for c in more]


def nearest(Q: np.ndarray, X: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of X, squared distance) of the ``k`` nearest rows, by query, distance and row number."""
    d, j = search(Q, held_blocks(X), k)
    found = j != NONE
    return np.nonzero(found)[0], j[found], d[found]


class KNNModel(Model, _KNNParams, StateWritable):
    def __init__(self):
        super().__init__()
        self.ids, self.X, self.y = np.zeros(0, object), np.zeros((0, 0)), np.zeros(0)
        self.table: str | None = None  # of the rows, if they are too many to hold
        self._files: list[str] = []
        self._shared = None

    def _take(self, rows: pa.Table) -> None:
        """From (tid, x, y): the numbers stay in flat arrays, no object per value."""
        ids = rows["tid"].to_pandas()
        order = ids.sort_values(kind="stable").index.to_numpy()
        self.ids, self.y = ids.to_numpy(object)[order], rows["y"].to_pandas().to_numpy(float)[order]
        flat = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.X = flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0))
        self.table, self._shared = None, None

    def _read(self, spark: SparkSession, path: str) -> None:
        """From the table (pos, tid, x, y) at ``path``: only its files' names are held."""
        self.table, self._files = path, sorted(spark.read.parquet(path).inputFiles())

    def _blocks(self, spark: SparkSession, *more: str):
        """The training rows in blocks, to be called in the tasks; ``more`` of tid and y."""
        if self.table is not None:
            files = self._files
            return lambda: table_blocks(files, *more)
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast((self.ids, self.X, self.y))
        shared, places = self._shared, [("tid", "X", "y").index(c) for c in more]
        return lambda: held_blocks(shared.value[1], *[shared.value[c] for c in places])

    def neighbours(self, df: DataFrame) -> DataFrame:
        """(qid, tid, dist, y): the k nearest training rows of every query row; dist is squared."""
        blocks, k = self._blocks(df.sparkSession, "tid", "y"), self.getOrDefault("k")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    d, j, *more = search(np.vstack(part["x"].to_numpy()), blocks(), k)
                    found = j != NONE
                    tid, y = (m[found] for m in more) if more else (np.zeros(0, object), np.zeros(0))
                    yield pd.DataFrame({"qid": part["qid"].to_numpy()[np.nonzero(found)[0]], "tid": tid, "dist": d[found], "y": y})

        q = df.select(F.col(self.getOrDefault("idCol")).cast("string").alias("qid"), vector_to_array("features").alias("x"))
        return q.mapInPandas(run, "qid string, tid string, dist double, y double")

    def _spread(self, df: DataFrame) -> DataFrame:
        """Queries on all cores: a table of few files would be compared by a few tasks."""
        cores, key = df.sparkSession.sparkContext.defaultParallelism, self.getOrDefault("idCol")
        if df.rdd.getNumPartitions() >= 2 * cores:
            return df
        return df.repartition(4 * cores, *[c for c in df.columns if c == key])

    def _transform(self, df: DataFrame) -> DataFrame:
        blocks, k = self._blocks(df.sparkSession, "y"), self.getOrDefault("k")

        def votes(parts: list[pa.Array]) -> Iterator[pa.Array]:
            Q = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in parts])
            rows = sum(map(len, parts))
            _, j, *y = search(Q.reshape(rows, -1), blocks(), k) if rows else (None, np.zeros((0, k)))
            found = j != NONE
            with np.errstate(invalid="ignore"):
                p = np.where(found, y[0], 0.0).sum(axis=1) / found.sum(axis=1) if y else np.full(rows, np.nan)
            ends = np.cumsum([0, *map(len, parts)])
            for a, b in zip(ends, ends[1:]):
                yield pa.array(p[a:b])

        @F.arrow_udf(T.DoubleType())
        def vote(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            waiting: list[pa.Array] = []
            for part in parts:
                waiting.append(part)
                if sum(map(len, waiting)) >= QUERIES:
                    yield from votes(waiting)
                    waiting = []
            if waiting:
                yield from votes(waiting)

        out = self._spread(df).withColumn("_p", vote(vector_to_array("features")))
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))) \
            .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")

    def save_state(self, spark: SparkSession, path: str) -> None:
        if self.table is not None:
            _write(spark.read.parquet(self.table), f"{path}/rows")
            return
        rows = list(zip(self.ids.tolist(), self.X.tolist(), self.y.tolist()))
        spark.createDataFrame(rows, "tid string, x array<double>, y double").write.parquet(f"{path}/rows")

    def load_state(self, spark: SparkSession, path: str) -> None:
        rows = spark.read.parquet(f"{path}/rows")
        if "pos" in rows.columns:
            self._read(spark, f"{path}/rows")
        else:
            self._take(rows.toArrow())
