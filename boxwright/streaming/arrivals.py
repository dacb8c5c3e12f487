"""Detections that arrive as files: an extension, not something the batch operators need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prediction_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of whole prediction files (path, value), at most per_trigger a batch."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return stream.select(F.input_file_name().alias("path"), "value")


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch through a batch operator; what is there is worked off, then the query ends. Batch numbers repeat
    after a restart, so a handler that writes to a folder per number is idempotent."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, lateness: str) -> DataFrame:
    """Counts per key and event-time window, rows later than the watermark left out."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), key).count()
