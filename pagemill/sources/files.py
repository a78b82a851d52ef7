"""Files as tables, and tables as files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X

WORDS = "doc_id string, page_number int, word_idx int, text string, x0 double, x1 double, top double, bottom double, font_size double"
MAX_UPLOAD = 512 * 1024 * 1024


def sources(spark: SparkSession, path: str, media_type: str = "application/pdf") -> DataFrame:
    """doc_id, path, media_type, size_bytes, sha256, modified_at of files; doc_id is the hash."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", F.lit(media_type).alias("media_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")).withColumn("doc_id", F.col("sha256"))


def unstable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size or time changed between two listings."""
    key = ["path", "size_bytes", "modified_at"]
    return before.select(*key).join(after.select(*key), key, "left_anti").select("path")


def uploadable(rows: DataFrame) -> DataFrame:
    return rows.where(F.lower("path").endswith(".pdf") & (F.col("size_bytes") <= MAX_UPLOAD))


def decode(files: DataFrame, decoder: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str = WORDS) -> DataFrame:
    """Words of binary files by a decoder of one's own (a PDF library, an OCR engine); none is required."""
    return files.mapInPandas(decoder, schema)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, markdown of whole text files; blank ones are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))
    return rows.where(~X.is_blank(F.col("markdown")))


def manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, manifest, valid: one JSON object a file, of version 1.0."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("manifest"))
    return rows.withColumn("valid", F.coalesce(F.col("manifest.schema_version") == "1.0", F.lit(False)))


def publish(payload: DataFrame, manifest: DataFrame, path: str, *, on_conflict: str = "error") -> None:
    """Write the payload, then the manifest, whose presence says that the payload is whole."""
    mode = {"error": "errorifexists", "overwrite": "overwrite"}[on_conflict]
    payload.write.mode(mode).parquet(f"{path}/payload")
    manifest.write.mode(mode).parquet(f"{path}/manifest")


def add_missing(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't there yet; what exists is kept."""
    return new.join(existing.select(*key), key, "left_anti")


def save_state(state: DataFrame, path: str) -> None:
    """The run state of documents, replaced partition by partition."""
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def rejects(rows: DataFrame) -> DataFrame:
    """Rejected results with a short name from their response id."""
    return rows.withColumn("name", F.concat(F.lit("rejected-"), F.left(F.sha2("response_id", 256), F.lit(12))))
