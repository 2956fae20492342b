"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions that run on executors travel by value: executors need NumPy, pandas and PyArrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules["retainlab"])


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "retainlab") -> SparkSession:
    """Return (or create) a session with the settings the library relies on.

    On a cluster the master and most settings come from spark-submit; this only
    fills in what is unset.  ``spark.checkpoint.dir`` is left alone when the
    cluster names one; locally (tests) a scratch folder is taken.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # local mode runs everything in the driver JVM; ignored when the JVM already exists
        "spark.driver.memory": os.environ.get("RETAINLAB_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="retainlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def once(df: DataFrame) -> DataFrame:
    """Derive ``df`` once: written to the shared checkpoint folder, so plans that read it
    several times read the written table instead of deriving it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, for tables written to cut lineage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


#: bytes of a generated method that the JVM still compiles; Spark's own limit is far above it
COMPILED_BYTES = 8000


def compile_wide_plans(spark: SparkSession) -> None:
    """Run plans whose whole-stage method is too large for the JVM to compile operator by operator: their
    projections are split into compiled methods (the 78-column matrix, interpreted else, takes a third of the time).
    A limit set by the user is kept."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, "65535") == "65535":
        spark.conf.set(key, str(COMPILED_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there: for tables of many rows, which
    are far smaller in it than in a checkpoint, and of which later plans read some columns only."""
    path = shared_path(df.sparkSession, f"tables/{uuid.uuid4().hex}")
    # plain values: with dictionaries a split of the file size Spark reads at once would hold millions of rows
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.parquet(path)
