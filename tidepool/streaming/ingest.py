"""Resumable ingestion: files in micro-batches, the latest row per review, and a live trend.

The checkpoint folder is the state: which files are done, which batch came
last. A batch writes a folder named by its number, so one that runs again
replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reviews import latest
from ..schema import UNIFIED
from ..sources.specs import SPECS, unify


def raw_stream(spark: SparkSession, folder: str, source: str, files_per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.schema(SPECS[source].schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl")
    return reader.json(folder)


def ingest(spark: SparkSession, folder: str, source: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Unified rows of all files that aren't done yet, a folder per batch; ends when none is left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = unify(raw_stream(spark, folder, source, files_per_batch), SPECS[source])
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All batches, one row per review, the latest: the same as a batch run over the same files."""
    return latest(spark.read.schema(UNIFIED).parquet(target).select(*UNIFIED.names))


def first_seen(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each review once, as it first arrives; state is dropped after the delay."""
    return stream.withWatermark("review_date", delay).dropDuplicatesWithinWatermark(["review_id"])


def live_trend(stream: DataFrame, window: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Reviews per window and source: an extension, for sources that are truly unbounded."""
    counted = stream.withWatermark("review_date", delay).groupBy(F.window("review_date", window), "source").agg(F.count("*").alias("review_count"))
    return counted.select(F.col("window.start").alias("window_start"), "source", "review_count")
