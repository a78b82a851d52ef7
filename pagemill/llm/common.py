"""Shared folder, scratch tables and Arrow helpers of the operators."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's XXH64 seed, which is also the contract's.
SEED = 42


#: Rows of an Arrow batch between Spark and Python. Batches of the default 10,000 documents
#: keep some hundred MB of buffers in either process.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, unless they are set lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is missing (a local session, as in tests) a temporary
    folder takes its place; a cluster without the setting is an error.
    """
    small_batches(spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='pagemill-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/pagemill-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shipped(spark: SparkSession, value: object):
    """A broadcast of an object with its class, which workers need not be able to import; see received()."""
    small_batches(spark)
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared) -> object:
    return pickle.loads(shared.value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a scratch table in the shared folder and read it again.

    Cuts the lineage: what follows survives the loss of any executor without
    running df again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def uniform(*columns: Column) -> Column:
    """In [0, 1), from the hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / float(1 << 53)


def hash_sample(rows: DataFrame, by: str, n: int, most: int) -> DataFrame:
    """About the `most` rows with the smallest hash of `by`, of n rows; exactly those where all rows hash apart.

    A cut on the hash leaves about twice as many rows before they are sorted, so what
    meets in one task doesn't grow with the input.
    """
    share = min(1.0, (2.0 * most + 100) / max(n, 1))
    return rows.where(uniform(F.col(by)) < share).orderBy(uniform(F.col(by)), *rows.columns).limit(most)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column without copies: data, and n + 1 offsets.

    Null rows have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of the column, at least one row each."""
    _, at = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
