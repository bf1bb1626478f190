"""Stateful streaming operators over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Counts, errors and mean latency of tumbling hours; events later than the watermark are left out."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    by = rows.groupBy(F.window("at", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("mean")
    )
    return by.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", "errors", "mean")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "3 hours", watermark: str = "2 days") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    by = rows.groupBy(F.window("at", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "4 hours", watermark: str = "2 days") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    by = rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n")


def deduplicated(events: DataFrame, keys: list[str], watermark: str = "2 days") -> DataFrame:
    """Overlapping re-reads made idempotent: each key once within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark).dropDuplicatesWithinWatermark(keys).drop("at")


def transitions(events: DataFrame) -> DataFrame:
    """user_id, event_id, was, event_type: changes of a user's status; the last status is kept as state.

    The first status is the baseline and silent. A batch's rows go by (ts, event_id).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["ts", "event_id"], kind="stable")
        was = pd.Series([state.get[0] if state.exists else None, *rows["event_type"].iloc[:-1]], index=rows.index, dtype=object)
        state.update((rows["event_type"].iloc[-1],))
        changed = was.notna() & (was != rows["event_type"])
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"][changed], "was": was[changed], "event_type": rows["event_type"][changed]})

    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, was string, event_type string", "status string", "append", GroupStateTimeout.NoTimeout
    )


def alerts_once(events: DataFrame, watch: str = "purchase") -> DataFrame:
    """user_id, event_id: one alert for each user and content; what was alerted is kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["ts", "event_id"], kind="stable")
        if not state.exists:
            state.update((True,))
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [rows["event_id"].iloc[0]]})

    rows = events.where(F.col("event_type") == watch).select("user_id", "event_id", "ts", F.sha2(F.concat("event_type", F.lit(":"), "props").cast("binary"), 256).alias("digest"))
    return rows.groupBy("user_id", "digest").applyInPandasWithState(step, "user_id long, event_id long", "alerted boolean", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, target: str, key: str, version: str):
    """A writer that keeps the newest row of each key in the Parquet folder ``target``, batch by batch.

    Each batch writes a new generation beside the old one and then names it; a batch that is replayed writes the
    same generation again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        old = f"{target}/gen={number - 1}"
        fs = fs_path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = batch
        if fs.exists(fs_path(old)):
            rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), version).alias("r")).select(key, "r.*")
        newest.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/gen={number}")

    return stream.writeStream.foreachBatch(put)
