"""Ordered lookups inside keys of any size: previous rows, last known values, ranks.

Rows are range-partitioned by (key, order) with bounds that Spark samples, so a key with a third of all
rows is cut like any other. Inside a (key, partition) plain windows serve; what comes from the partitions before is one
row per (key, partition). The partitioned rows are stored, as bounds are sampled anew by
every execution. A NULL key is a key like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.session import checkpoint_path


def ranged(df: DataFrame, key: str, order: tuple, partitions: int | None = None) -> DataFrame:
    by = (key, *order)
    return df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again. Unlike a checkpoint the table has its true
    size, so plans that are built on it in a loop don't multiply estimates."""
    path = checkpoint_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _with_partitions(df: DataFrame, key: str, order: tuple, partitions: int | None) -> DataFrame:
    return stored(ranged(df, key, order, partitions).withColumn("_pid", F.spark_partition_id()))


def _joined(d: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    edges = edges.withColumnRenamed(key, "_key").withColumnRenamed("_pid", "_p")
    return d.join(edges, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_pid") == F.col("_p")),
                  "left").drop("_key", "_p")


def last_known(df: DataFrame, key: str, order: tuple, value: Column, name: str,
               before: bool = False, partitions: int | None = None) -> DataFrame:
    """Add ``name``: the last ``value`` that is not NULL up to the row (``before``: up to the one
    before it) among the rows of the same ``key`` in ``order``; NULL if there is none."""
    d = _with_partitions(df.withColumn("_v", value), key, order, partitions)
    w = Window.partitionBy(key, "_pid").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("_v").isNotNull(), F.struct(*order))
    edges = d.groupBy(key, "_pid").agg(F.max_by("_v", at).alias("_e")).select(
        key, "_pid", F.last("_e", ignorenulls=True).over(earlier).alias("_carry"))
    local = d.withColumn("_here", F.last("_v", ignorenulls=True).over(w))
    return _joined(local, edges, key).withColumn(name, F.coalesce("_here", "_carry")).drop(
        "_v", "_here", "_carry", "_pid")


def ranks(df: DataFrame, key: str, order: tuple, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: the row's place (from 0) among the rows of the same ``key`` in ``order``."""
    d = _with_partitions(df, key, order, partitions)
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    edges = d.groupBy(key, "_pid").agg(F.count("*").alias("_n")).select(
        key, "_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    local = d.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_pid").orderBy(*order)))
    return _joined(local, edges, key).withColumn(
        name, (F.col("_base") + F.col("_place") - 1).cast("long")).drop("_base", "_place", "_pid")


def running_sum(df: DataFrame, key: str, order: tuple, value: str, name: str,
                partitions: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the same ``key`` in ``order``."""
    d = _with_partitions(df, key, order, partitions)
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    edges = d.groupBy(key, "_pid").agg(F.sum(value).alias("_n")).select(
        key, "_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _joined(local, edges, key).withColumn(name, F.col("_base") + F.col("_here")).drop(
        "_base", "_here", "_pid")
