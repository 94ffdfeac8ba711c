"""Shared helpers: tables in the cluster's shared folder, and batches of bytes for numpy."""

from __future__ import annotations

import atexit
import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.session import delete, shared_folder

#: A word: a run of characters that are neither a space nor one of tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


class Workspace:
    """Intermediate tables as Parquet under the shared folder.

    A saved table cuts the lineage and outlives any executor. Tables are deleted by ``drop`` or,
    if still there, when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/loamlearn-{name}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        del df
        self.release()
        return out

    def release(self) -> None:
        """Lets the driver's cleaner delete the shuffle files of finished jobs now, not at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
                delete(self.spark, self.root)
        except Exception:  # the JVM may be gone; the files then stay for the cluster's own cleaner
            pass


def free_name(df: DataFrame, stem: str) -> str:
    """A name with which no column of ``df`` begins."""
    name, taken = f"__{stem}", [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def give_back() -> None:
    """Returns freed memory to the system: workers live on between groups and stages, beside the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (all bytes, offsets), without a copy for strings; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
