"""Session helpers of the subpackage: shared checkpoints, private column names, tables."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.session import ensure_checkpoint_dir

# Worker functions travel by value: executors need NumPy and PyArrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules["retainlab"])


#: most bytes of a record batch sent to a Python worker (a single longer row is a batch of its own)
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in batches of bounded size; a size given with the submission stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for reused workers: a worker does not hold on to the memory peak of the tasks before."""
    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return outer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns; extra columns, whatever they are called, never reach a worker."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def fold_of(col: str, parts: int):
    """crc32 of the id as text modulo ``parts``; a null id has remainder null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % parts


#: keys that hold more than one row in HOT_SHARE are looked up apart; there are fewer than HOT_SHARE of them
HOT_SHARE = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined to the one row that ``table`` holds for each ``key``; ``n`` of ``table`` counts the rows of the key.

    A key that holds more than one row in ``HOT_SHARE`` would fill one task of a shuffle; there are fewer than
    ``HOT_SHARE`` such keys, so their rows of ``table`` are broadcast and the rest is joined by shuffle.
    """
    total = table.select(F.sum(n)).scalar()
    hot = table.where(F.col(n) * HOT_SHARE > total).drop(n)
    rest = table.where(F.col(n) * HOT_SHARE <= total).drop(n)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))
