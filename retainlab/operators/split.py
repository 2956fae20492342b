"""Stratified splits, k-fold assignment and row samples.

The reference shuffles with a seeded RNG; here the "shuffle" is the order of
``md5(id || '#' || seed)`` (then id), so the assignment is a pure function of
the data -- reproducible across engines, reruns and lost executors.  Ranks
inside each class come from range-partitioned global ranks
(:func:`hash_rank`): the hash prefix splits each class into 65,536 balanced
buckets, never gathered in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retainlab.functions.ordered import HASH_DIGITS, hash_rank


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")))


def class_ranks(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Adds ``rank`` (0-based position inside the label class) and ``rank_group_size``."""
    keyed = df.withColumn("_shuffle", shuffle_key(id_col, seed))
    return hash_rank(keyed, [label], "_shuffle", id_col, "rank").drop("_shuffle")


def stratified_split(df: DataFrame, label: str = "dropout_status", id_col: str = "student_id",
                     seed: int = 42, test_pct: int = 20, val_pct: int = 20) -> DataFrame:
    """Adds ``split`` in {train, val, test}; per class ceil(test%) test rows,
    then ceil((test+val)%) - that for validation, the rest train."""
    r = class_ranks(df, label, id_col, seed)
    rank, n = F.col("rank"), F.col("rank_group_size")
    split = (F.when(rank * 100 < n * test_pct, "test")
             .when(rank * 100 < n * (test_pct + val_pct), "val").otherwise("train"))
    return r.withColumn("split", split).drop("rank", "rank_group_size")


def identified(df: DataFrame, id_col: str = "student_id") -> bool:
    """Whether every row has an id of its own."""
    ids = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return ids.where((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).isEmpty()


def cut_split(df: DataFrame, label: str = "dropout_status", id_col: str = "student_id",
              seed: int = 42, test_pct: int = 20, val_pct: int = 20) -> DataFrame:
    """:func:`stratified_split` of rows with ids of their own (:func:`identified`) without moving them.

    The split changes at two places of a class's order.  Counts by hash prefix and the rows of the
    prefixes that hold these places give them (two keys a class reach the driver); a row then needs
    only its own key.  ``df`` is read three times: pass a stored table.
    """
    h = shuffle_key(id_col, seed)
    keys = df.select(F.col(label).alias("y"), F.col(id_col).alias("id"), h.alias("h"))
    keys = keys.withColumn("bk", F.substring("h", 1, HASH_DIGITS))
    own = W.partitionBy("y")
    bins = keys.groupBy("y", "bk").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.select("y", "bk", "n", F.sum("n").over(own.orderBy("bk")).alias("cum"), F.sum("n").over(own).alias("size"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.col("size") * pct / 100).cast("long").alias("at"))
                       for name, pct in (("val", test_pct), ("train", test_pct + val_pct))])
    bins = bins.select("*", F.explode(places).alias("p")).select("*", "p.*")
    held = bins.where((F.col("cum") - F.col("n") <= F.col("at")) & (F.col("at") < F.col("cum")))
    held = held.select(F.col("y").alias("_y"), F.col("bk").alias("_bk"), "name", (F.col("at") - F.col("cum") + F.col("n")).alias("nth"))
    near = keys.join(F.broadcast(held), F.col("y").eqNullSafe(F.col("_y")) & (F.col("bk") == F.col("_bk")))
    rank = F.row_number().over(W.partitionBy("_y", "name").orderBy("h", "id")) - 1
    cuts = near.select("*", rank.alias("_rank")).where(F.col("_rank") == F.col("nth")).select("_y", "name", "h", "id").collect()

    split, found = None, {(r["_y"], r["name"]): r for r in cuts}
    for name in ("train", "val"):  # the later part first
        for (y, at), r in found.items():
            if at != name:
                continue
            beyond = (F.col("_h") > r["h"]) | ((F.col("_h") == r["h"]) & (F.col(id_col) >= F.lit(r["id"])))
            mine = F.col(label).eqNullSafe(F.lit(y)) & beyond
            split = F.when(mine, name) if split is None else split.when(mine, name)
    split = F.lit("test") if split is None else split.otherwise("test")
    return df.withColumn("_h", h).withColumn("split", split).drop("_h")


def kfold(df: DataFrame, label: str = "dropout_status", id_col: str = "student_id",
          k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold number ``fold`` in [0, k) (round-robin over class ranks)."""
    r = class_ranks(df, label, id_col, seed)
    return r.withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank", "rank_group_size")


def sample_rows(df: DataFrame, n: int = 100, id_col: str = "student_id", seed: int = 42) -> DataFrame:
    """D3: up to ``n`` rows without replacement, seeded (top-k by hash: each task
    keeps its best ``n``, then one merge of bounded size)."""
    return df.orderBy(shuffle_key(id_col, seed), id_col).limit(n)


def background_rows(df: DataFrame, n: int = 100, id_col: str = "student_id") -> DataFrame:
    """The first ``n`` rows by id (explainer background)."""
    return df.orderBy(id_col).limit(n)
