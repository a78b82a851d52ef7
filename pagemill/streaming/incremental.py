"""Structured Streaming: new pages to blocks, windows over telemetry. An addition, with no counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import blocks as B


def page_stream(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_blocks(pages: DataFrame, target: str, checkpoint: str):
    """Start a query that turns pages(doc_id, page_number, text) into blocks, batch by batch.

    Pages are whole rows, so a batch needs nothing of earlier ones; a batch that is run
    again replaces its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        B.build_blocks(B.classify(B.lines_of(batch))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def durations(events: DataFrame, *, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Runs and milliseconds per window of their start; rows later than `late` are dropped."""
    return events.withWatermark("started_at", late).groupBy(F.window("started_at", window)).agg(F.count(F.lit(1)).alias("runs"), F.sum("duration_ms").alias("duration_ms"))
