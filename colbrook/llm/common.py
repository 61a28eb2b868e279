"""Helpers shared by the operators: shared-folder tables, worker paths, Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import WRITTEN, delete_tables, send_package, shared_folder, write_table

#: White space of every text contract: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


#: Bytes of text that go to a Python worker at once, whatever the length of the texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def prepare(spark: SparkSession) -> None:
    """Send this package to the workers and bound Arrow batches."""
    send_package(spark)
    limit = spark.conf.get(BATCH_SETTING, None)
    if limit is None or not limit.isdigit() or int(limit) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return write_table(df, name)[0]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    delete_tables(spark, list(paths))


#: Most keys that a filter broadcasts; beyond, the filter is a shuffled join.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not among the dropped ones.

    Texts stay where they are while the dropped keys are few enough to be broadcast.
    """
    dropped = materialise(dropped.select(key), "dropped")
    small = dropped.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(dropped) if small else dropped, key, "left_anti")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_mod(n: int, column: str = "doc_id") -> Column:
    """crc32(id as text) mod n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def trim() -> None:
    """Gives a worker's free memory back: workers are kept for later tasks, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow where ``make`` builds the batch function once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield f(b)
        f = None
        trim()

    return df.mapInArrow(run, schema)


class Memo(dict):
    """key -> compute(key), of bounded size: two generations of at most `limit` entries.

    When the young one is full it becomes the old one; what is asked for again moves over, so
    frequent keys stay. Keys of 64 characters or more are computed each time.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) < 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def words_of(data: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at the six white-space characters (bytes.split has just these)."""
    return data.lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binaries(column: pa.Array) -> list[bytes]:
    return [b"" if v is None else v for v in column.to_pylist()]


__all__ = ["F", "Memo", "StorageLevel", "WHITE", "WRITTEN", "binaries", "id_mod", "map_batches", "materialise", "mix64", "prepare", "release", "shared_folder", "text_bytes", "trim", "without", "words_of"]
