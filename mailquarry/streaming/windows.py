"""Streams of messages: windowed counts, sessions, duplicates within a watermark, per-contact state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailquarry.operators.lineage import shared_folder


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream with an event time in time zone of the session."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days", key: str = "event_type") -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(stream: DataFrame, gap: str = "1 day", late: str = "2 days", key: str = "user_id") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_copies(stream: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_counts(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, n, last): messages so far of each contact, by state that Spark keeps and restores."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for b in batches:
            n += len(b)
            top = b["ts"].max().to_pydatetime()
            last = top if last is None or top > last else last
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last": [last]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, last timestamp", "n long, last timestamp", "update", GroupStateTimeout.NoTimeout)


#: State of a stream in RocksDB: on the executors' disks with bounded memory, instead of whole in their heaps.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns what it gave: in complete mode its last batch, else all its batches.

    Batches are Parquet files in the shared folder, so no rows pass through the driver. A batch that is run again
    replaces its files. Without input there are no rows.
    """
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    paths: dict[int, str] = {}

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{k}")
        paths[k] = f"{folder}/rows/{k}"

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/state").start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if not paths:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*([paths[max(paths)]] if mode == "complete" else paths.values()))
