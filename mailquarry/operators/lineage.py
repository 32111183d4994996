"""Cutting lineage, and numbering rows of whole tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share (a temporary one only on one machine)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with row numbers from 0 in a total order, without a task that sees all rows.

    Rows are dealt by ranges and sorted within them, and written, so that ranges stay as they are. A row's number is that
    of its range's first row and its place in the range; only the sizes of the ranges, one for each partition, are
    gathered.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes, at, first = placed.groupBy("_range").count().orderBy("_range").collect(), 0, []
    for r in sizes:
        first.append((r["_range"], at))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(first or [(0, 0)], "_range int, _first long")
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")
