"""Streams: the latest value of each key, and episodes applied to a store as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.log import latest
from palimpsest.plans.scratch import shared_dir
from palimpsest.sources.store import EPISODE


def latest_values(spark: SparkSession, log: DataFrame, out: str) -> DataFrame:
    """Runs a streaming change log to its end and returns (slot, key, value, ...) of the keys that aren't removed.

    Each micro-batch keeps only its last version of each key, so what is appended
    per batch is bounded by its keys; the batches' results are merged on reading.
    """

    def apply(batch: DataFrame, number: int) -> None:
        from palimpsest.operators.log import last

        last(batch).write.mode("overwrite").parquet(f"{out}/batches/{number}")

    query = log.writeStream.foreachBatch(apply).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.parquet(f"{out}/batches/*"))


def follow_episodes(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Runs a stream over the episodes of a folder and returns all rows it has taken; the checkpoint makes a second run take only what is new.

    A batch writes to a folder named by its number, so running it again after a failure changes nothing.
    """
    stream = spark.readStream.schema(EPISODE).parquet(f"{path}/*")

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batches/{number}")

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(EPISODE).parquet(f"{out}/batches/*")


def event_log(events: DataFrame) -> DataFrame:
    """The events table as a change log: users are keys, and an error removes the value."""
    return events.select(F.lit(0).alias("slot"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("is_removed"), F.unix_millis(F.col("ts").cast("timestamp")).alias("commit_ts"), F.col("event_id").alias("seq"))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*").parquet(f"{path}*")
    return latest_values(spark, event_log(events), f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex[:12]}")
