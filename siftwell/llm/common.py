"""Shared helpers: the shared folder, written intermediate tables, byte views of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in one Arrow batch handed to a Python worker; keeps a batch of long texts small.
ROWS_PER_BATCH = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new one on a single machine, an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftwell-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch for this session, so that long texts don't pile up in a worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def whole_row(docs: DataFrame) -> Column:
    """Each row as one struct, whatever its columns are called."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def schema_with(kept: StructType, more: str) -> StructType:
    """The fields of `kept`, and more of them by their DDL."""
    return StructType(kept.fields + StructType.fromDDL(more).fields)


def same_text(text: str = "text") -> Column:
    """A fingerprint of the whole text that tells rows with a repeated id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column as one array, and where each value begins (and the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    view = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return view, offsets - first


def row_slices(offsets: np.ndarray, most: int):
    """(first row, end row) of runs of whole rows of at most `most` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1, row + 1)
        yield row, min(end, n)
        row = min(end, n)
