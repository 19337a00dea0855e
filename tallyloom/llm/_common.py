"""What the text operators share: shared-folder tables, checked broadcasts, batch helpers.

Columns whose names begin with _tl_ are the operators' own: an input must have none.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be broadcast: 500,000 longs take about 16 MB in a hash relation.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch, which a task holds several times over (JVM, worker, result).
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is set in local mode; elsewhere that is an error, since a folder of the driver's own would lose rows."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: the text operators need a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and its size is known. discard() deletes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tl_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tl_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that the operators wrote to the session's shared folder, also those that results not yet written still read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tallyloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def batched(df: DataFrame) -> DataFrame:
    """df, once the session's Arrow batches have at most BATCH_BYTES: the setting is lowered, never raised, and holds when the plan runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key)
    said = re.fullmatch(r"(\d+)([bkmg]?)b?", (now or "").strip().lower())
    size = int(said[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[said[2]] if said else 0
    if not 0 < size <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give a Python worker's free memory back at a task's end: the worker is kept for tasks of other kinds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """keys (a materialised table), marked for broadcast only if it has at most so many rows; beyond that the join shuffles."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def utf8_lengths(column: pa.Array) -> np.ndarray:
    """The bytes of each row of a string or binary column; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, last exclusive) of at most so many bytes; a longer row has a run of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 in and out) that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
