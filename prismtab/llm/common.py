"""What the operators of this subpackage share: tables, scratch space, Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.functions.store import find_package

#: Words of the contracts: runs of bytes other than ASCII white space.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that one vectorised step works on; a single longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it. Where none is set, a run on this one machine takes a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="prismtab-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: later jobs neither recompute it nor depend on one executor."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: str) -> Column:
    """A key of the row's content: equal rows share it, and it survives recomputation."""
    return F.xxhash64(*columns)


def steps(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    if len(col) == 0:
        return
    ends = np.asarray(pc.cumulative_sum(pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())))
    at = 0
    while at < len(col):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def together(batches: Iterator[pa.RecordBatch], text: str, least: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many bytes of text, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    col = pc.fill_null(col, "")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of so many rows at most, for operators whose rows may be long; workers find this package."""
    find_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def release(spark: SparkSession) -> None:
    """Lets go of finished rounds: what the driver no longer refers to is collected, and Spark removes its shuffles and checkpoints."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
