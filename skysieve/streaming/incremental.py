"""Streams of catalogue files: stages over new files, append-only publication, deduplication by watermark.

Stages are stateless joins of a stream with static catalogues; each micro-batch is written below its number, so a batch
that runs again replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysieve.plans.stages import StageResult


def new_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_stage(stream: DataFrame, stage: Callable[[DataFrame], StageResult], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies a stage to every micro-batch; kept rows and flags go below out/kept and out/flags by batch."""

    def each(batch: DataFrame, number: int) -> None:
        result = stage(batch)
        result.flags.write.mode("overwrite").parquet(f"{out}/flags/batch={number}")
        result.kept.write.mode("overwrite").parquet(f"{out}/kept/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows of keys that haven't been seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows by tumbling window and keys, final once the watermark has passed."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
