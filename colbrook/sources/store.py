"""Stores: immutable versions of a columnar table with row identity, liveness, lock and level.

A store's DataFrame has the columns _row (its identity, 0-based), _valid, _locked, _level (0 is
the finest) and the declared data columns. Every write gives a new version; nothing is mutated.
Cells are never null.
"""

from __future__ import annotations

import logging
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import NUMPY, SPARK, WIDTH, Kind, convert_cell, kind_of, literal, wrapping, zero
from ..functions.ranks import ranked
from .shared import send_package, write_table

log = logging.getLogger("colbrook")
_sink: logging.Handler | None = None


def log_to(callback: Callable[[int, str], None] | None) -> None:
    """Sends this package's messages, as (level, text), to a callback; None: to the usual handlers."""
    global _sink
    if _sink:
        log.removeHandler(_sink)
    _sink, log.propagate = None, True
    log.setLevel(logging.NOTSET)
    if callback:
        _sink = logging.Handler()
        _sink.emit = lambda r: callback(r.levelno, r.getMessage())
        log.addHandler(_sink)
        log.setLevel(logging.INFO)
        log.propagate = False


META = ("_row", "_valid", "_locked", "_level")
#: What a full store answers to a row request.
FULL = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: Kind
    default: object = None

    @property
    def width(self) -> int:
        return WIDTH[self.kind]

    @property
    def initial(self):
        return zero(self.kind) if self.default is None else self.default

    def struct_field(self, tag: int) -> T.StructField:
        return T.StructField(self.name, SPARK[self.kind], False, {"tag": tag, "stride": self.width, "kind": self.kind.name})


@dataclass(frozen=True)
class Store:
    """One version. Methods that write return the next version.

    `pins` names the written tables that the frame reads.
    """

    frame: DataFrame
    columns: tuple[ColumnSpec, ...]
    capacity: int
    tag: str = "store"
    version: int = 1
    pins: tuple[str, ...] = ()

    # -- making and filling ------------------------------------------------------------------

    @classmethod
    def preallocated(cls, spark: SparkSession, columns: Iterable[ColumnSpec], rows: int, tag: str = "store") -> Store:
        """All cells zero, no row alive."""
        columns = tuple(columns)
        frame = spark.range(rows).select(*_meta(F.col("id")), *[literal(zero(c.kind), c.kind).alias(c.name) for c in columns])
        return cls(frame, columns, rows, tag)

    @classmethod
    def from_frame(cls, df: DataFrame, row: Expr | str, columns: Iterable[ColumnSpec] | None = None, capacity: int | None = None, valid: Expr | bool = True, locked: Expr | bool = False, level: Expr | int = 0, tag: str = "store", nulls: bool = True) -> Store:
        """A store over a table whose key is dense and 0-based; nulls become zeros.

        Say nulls=False of a table that has none: conditions on its columns then reach the scan.
        """
        row = F.col(row) if isinstance(row, str) else row
        if columns is None:
            columns = [ColumnSpec(f.name, kind_of(f.dataType)) for f in df.schema if not isinstance(f.dataType, (T.StringType, T.TimestampNTZType, T.ArrayType))]
        columns = tuple(columns)
        flag = lambda x: F.coalesce(x, F.lit(False)) if isinstance(x, Expr) else F.lit(x)
        lod = level if isinstance(level, Expr) else F.lit(level)
        frame = df.select(
            row.cast("bigint").alias("_row"), flag(valid).alias("_valid"), flag(locked).alias("_locked"), F.coalesce(lod, F.lit(0)).cast("smallint").alias("_level"),
            *[(F.coalesce(F.col(c.name).cast(SPARK[c.kind]), literal(zero(c.kind), c.kind)) if nulls else F.col(c.name).cast(SPARK[c.kind])).alias(c.name) for c in columns],
        )
        return cls(frame, columns, capacity if capacity is not None else -1, tag)

    @classmethod
    def from_rows(cls, spark: SparkSession, columns: Iterable[ColumnSpec], rows: list[tuple], extra: int = 0, valid: bool = False, tag: str = "store") -> Store:
        """Row-major data of driver size, then `extra` zero rows. Loaded rows are not alive unless asked."""
        return cls.preallocated(spark, columns, 0, tag).load(rows, valid).grown(extra)

    @classmethod
    def from_bytes(cls, spark: SparkSession, columns: Iterable[ColumnSpec], data: bytes, extra: int = 0, tag: str = "store") -> Store:
        """Row-major little-endian bytes, then `extra` zero rows; no row is alive."""
        store = cls.preallocated(spark, columns, 0, tag)
        if not store.row_stride or len(data) % store.row_stride:
            raise ValueError(f"{len(data)} bytes are no whole number of rows of {store.row_stride} bytes")
        return store.load_bytes(data).grown(extra)

    @classmethod
    def read(cls, spark: SparkSession, path: str, columns: Iterable[ColumnSpec], tag: str = "store") -> Store:
        """A store that `write` left."""
        frame = spark.read.parquet(path)
        return cls(frame, tuple(columns), -1, tag)

    def write(self, path: str) -> None:
        self.frame.write.parquet(path)

    @property
    def _schema(self) -> T.StructType:
        return T.StructType([T.StructField("_row", T.LongType(), False), T.StructField("_valid", T.BooleanType(), False), T.StructField("_locked", T.BooleanType(), False), T.StructField("_level", T.ShortType(), False), *[T.StructField(c.name, SPARK[c.kind], False) for c in self.columns]])

    def load(self, rows: list[tuple], valid: bool = False) -> Store:
        """Bulk replace: liveness, locks and levels start anew."""
        if not self.columns:
            raise ValueError("a store without columns cannot be loaded")
        filled = [(i, valid, False, 0, *r) for i, r in enumerate(rows)]
        return replace(self, capacity=len(rows), pins=())._next(self.frame.sparkSession.createDataFrame(filled, self._schema))

    def load_bytes(self, data: bytes) -> Store:
        """Bulk replace from row-major little-endian bytes; a partial last row is left out."""
        if not self.row_stride:
            raise ValueError("a store without columns cannot be loaded")
        rows = len(data) // self.row_stride
        cells = decode_rows(np.frombuffer(data, np.uint8, rows * self.row_stride).reshape(rows, -1), self.columns)
        meta = [pa.array(np.arange(rows)), pa.array(np.zeros(rows, bool)), pa.array(np.zeros(rows, bool)), pa.array(np.zeros(rows, np.int16))]
        table = pa.table([*meta, *cells], names=[*META, *[c.name for c in self.columns]])
        frame = self.frame.sparkSession.createDataFrame(table)
        return replace(self, capacity=rows, pins=())._next(frame.select(*[F.col(f.name).cast(f.dataType) for f in self._schema]))

    def load_frame(self, rows: DataFrame, row: str, data: str) -> Store:
        """Bulk replace from a table with a row number and the row's bytes, decoded on the executors."""
        columns, stride = self.columns, self.row_stride

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = [bytes(x) for x in b.column(1).to_pylist()]
                if any(len(x) != stride for x in cells):
                    raise ValueError(f"a row that is not of {stride} bytes")
                flat = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
                yield pa.RecordBatch.from_arrays([b.column(0), *decode_rows(flat, columns)], names=["_row", *[c.name for c in columns]])

        send_package(rows.sparkSession)
        schema = T.StructType([T.StructField("_row", T.LongType()), *[T.StructField(c.name, SPARK[c.kind]) for c in columns]])
        read = rows.select(F.col(row).cast("bigint").alias("_row"), F.col(data)).mapInArrow(run, schema)
        return replace(self, capacity=-1, pins=())._next(read.select(*_meta(F.col("_row")), *[c.name for c in columns]))

    def grown(self, rows: int) -> Store:
        """The store with dead zero rows added behind its last."""
        if not rows:
            return self
        n = self._rows()
        extra = self.preallocated(self.frame.sparkSession, self.columns, rows).frame.withColumn("_row", F.col("_row") + n)
        return replace(self, capacity=n + rows)._next(self.frame.unionByName(extra))

    def dump(self) -> DataFrame:
        """Data columns of all rows, dead ones too, by row."""
        return self.frame.orderBy("_row").select(*[c.name for c in self.columns])

    def dump_bytes(self) -> DataFrame:
        """(_row, data): each row's cells as row-major little-endian bytes, dead rows too."""
        columns = self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = zip(*[[encode_cell(v, c.kind) for v in b.column(i + 1).to_pylist()] for i, c in enumerate(columns)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(x) for x in cells], pa.binary())], names=["_row", "data"])

        send_package(self.frame.sparkSession)
        return self.frame.select("_row", *[c.name for c in columns]).mapInArrow(run, "_row long, data binary")

    def _next(self, frame: DataFrame) -> Store:
        return replace(self, frame=frame, version=self.version + 1)

    def _rows(self) -> int:
        return self.capacity if self.capacity >= 0 else self.frame.count()

    # -- shape -------------------------------------------------------------------------------

    def spec(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def row_count(self) -> int:
        """Capacity."""
        return self._rows()

    @property
    def column_count(self) -> int:
        return len(self.columns)

    @property
    def row_stride(self) -> int:
        return sum(c.width for c in self.columns)

    def column_stride(self, name: str) -> int:
        c = self.spec(name)
        return c.width if c else 0

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.struct_field(i) for i, c in enumerate(self.columns)])

    # -- cells and row flags -----------------------------------------------------------------

    def get(self, row: int, name: str):
        """The cell, of dead rows too; None outside the store."""
        if not self.spec(name):
            return None
        found = self.frame.where(F.col("_row") == row).select(name).head()
        return None if found is None else found[0]

    def set(self, row: int, name: str, value) -> Store:
        """Writes one cell, cut to the column's width; nothing happens outside the store."""
        c = self.spec(name)
        if c is None:
            return self
        return self.updated(self.frame.withColumn(name, F.when(F.col("_row") == row, literal(value, c.kind)).otherwise(F.col(name))))

    def write_cells(self, name: str, edits: DataFrame) -> Store:
        """Writes one column from (row, value) edits with unique rows; others keep their cell."""
        c = self.spec(name)
        if c is None:
            return self
        new = edits.select(edits[edits.columns[0]].cast("bigint").alias("__row"), edits[edits.columns[1]].cast(SPARK[c.kind]).alias("__value"))
        joined = self.frame.join(new, self.frame["_row"] == new["__row"], "left")
        cells = [F.coalesce("__value", name).alias(name) if o.name == name else F.col(o.name) for o in self.columns]
        return self.updated(joined.select(*META, *cells))

    def try_set(self, row: int, name: str, value) -> tuple[bool, Store]:
        ok = self.spec(name) is not None and self.frame.where(F.col("_row") == row).head() is not None
        return ok, self.set(row, name, value) if ok else self

    def _flag(self, name: str, at: Expr, value: Expr) -> Store:
        return self._next(self.frame.withColumn(name, F.when(at, value).otherwise(F.col(name))))

    def set_valid(self, rows: int | Expr, value: bool = True) -> Store:
        return self._flag("_valid", _at(rows), F.lit(value))

    def set_locked(self, rows: int | Expr, value: bool = True) -> Store:
        """A flag to carry; no update, view or commit asks for it."""
        return self._flag("_locked", _at(rows), F.lit(value))

    def set_level(self, rows: int | Expr, value: int) -> Store:
        return self._flag("_level", _at(rows), F.lit(min(255, max(0, value))).cast("smallint"))

    def _meta_of(self, row: int, name: str, other):
        found = self.frame.where(F.col("_row") == row).select(name).head()
        return other if found is None else found[0]

    def is_valid(self, row: int) -> bool:
        return self._meta_of(row, "_valid", False)

    def is_locked(self, row: int) -> bool:
        return self._meta_of(row, "_locked", False)

    def level(self, row: int) -> int:
        return self._meta_of(row, "_level", 0)

    def live_count(self) -> int:
        """Live rows; a job for the first call, kept by this version and those that updates make of it."""
        return self._live

    @cached_property
    def _live(self) -> int:
        return self.frame.where("_valid").count()

    def updated(self, frame: DataFrame) -> Store:
        """The next version by a write to cells: the same rows are alive."""
        out = self._next(frame)
        if "_live" in self.__dict__:
            out.__dict__["_live"] = self._live
        return out

    def live(self) -> DataFrame:
        return self.frame.where("_valid")

    # -- allocation --------------------------------------------------------------------------

    def free_slots(self, limit: int | None = None) -> DataFrame:
        """(_slot, _k): the k-th lowest dead row."""
        free = self.frame.where(~F.col("_valid")).select(F.col("_row").alias("_slot"))
        if limit is not None:
            free = free.orderBy("_slot").limit(limit)
        return ranked(free, "_slot", "_k")

    def revive(self, slots: DataFrame, values: dict[str, str] | None = None) -> Store:
        """Brings `_slot` rows to life with default cells, or the given columns of `slots`."""
        values = values or {}
        own = slots.select(F.col("_slot").alias("__row"), F.lit(True).alias("__hit"), *[F.col(v).alias(f"__{c}") for c, v in values.items()])
        joined = self.frame.join(own, self.frame["_row"] == own["__row"], "left")
        hit = F.coalesce(F.col("__hit"), F.lit(False))
        cells = []
        for c in self.columns:
            new = F.coalesce(F.col(f"__{c.name}").cast(SPARK[c.kind]), literal(c.initial, c.kind)) if c.name in values else literal(c.initial, c.kind)
            cells.append(F.when(hit, new).otherwise(F.col(c.name)).alias(c.name))
        return self._next(joined.select("_row", (F.col("_valid") | hit).alias("_valid"), "_locked", F.when(hit, F.lit(0).cast("smallint")).otherwise(F.col("_level")).alias("_level"), *cells))

    def allocate(self, count: int = 1) -> tuple[list[int], Store]:
        """The lowest `count` dead rows (fewer when the store is full), alive with default cells.

        Of driver size, as their numbers are returned; `revive` takes any number.
        """
        slots = [r[0] for r in self.free_slots(count).select("_slot").orderBy("_slot").collect()]
        if not slots:
            return [], self
        frame = self.frame.sparkSession.createDataFrame([(s,) for s in slots], "_slot bigint")
        return slots, self.revive(frame)

    def free(self, rows: int | Expr | DataFrame) -> Store:
        """Rows die and unlock; cells and level stay until the next allocation."""
        if isinstance(rows, DataFrame):
            dead = rows.select(F.col(rows.columns[0]).alias("__row")).distinct().withColumn("__hit", F.lit(True))
            joined = self.frame.join(dead, self.frame["_row"] == dead["__row"], "left")
            hit = F.coalesce(F.col("__hit"), F.lit(False))
            return self._next(joined.select("_row", (F.col("_valid") & ~hit).alias("_valid"), (F.col("_locked") & ~hit).alias("_locked"), "_level", *[c.name for c in self.columns]))
        at = _at(rows)
        return self._next(self.frame.withColumn("_locked", F.col("_locked") & ~at).withColumn("_valid", F.col("_valid") & ~at))

    # -- schema ------------------------------------------------------------------------------

    def convert(self, columns: Iterable[ColumnSpec]) -> Store:
        """Columns matched by name keep their bytes in the new width; others begin at their default.

        Whole kinds are converted by expressions, bytes of floating kinds and GUIDs by an Arrow function.
        """
        columns = tuple(columns)
        cells = []
        for c in columns:
            old = self.spec(c.name)
            cells.append((self._copied(old, c) if old else literal(c.initial, c.kind)).alias(c.name))
        with wrapping(self.frame.sparkSession):
            return replace(self, frame=self.frame.select(*META, *cells), columns=columns, version=self.version + 1)

    def _copied(self, old: ColumnSpec, new: ColumnSpec) -> Expr:
        bytewise = {old.kind, new.kind} & {Kind.FLOAT, Kind.DOUBLE, Kind.GUID}
        if old.kind == new.kind or not bytewise:
            return convert_cell(F.col(old.name), old.kind, new.kind)
        send_package(self.frame.sparkSession)
        return byte_copy(old.kind, new.kind)(F.col(old.name))

    def pinned(self, folder: str | None = None) -> Store:
        """The same version with its lineage cut: written to the shared folder and read back."""
        frame, path = write_table(self.frame, self.tag, folder)
        log.info("store %s version %d written to %s", self.tag, self.version, path)
        return replace(self, frame=frame, pins=(path,))


def decode_rows(flat: np.ndarray, columns: tuple[ColumnSpec, ...]) -> list[pa.Array]:
    """Columns of (rows, stride) bytes."""
    out, at = [], 0
    for c in columns:
        raw = np.ascontiguousarray(flat[:, at : at + c.width])
        at += c.width
        if c.kind == Kind.GUID:
            out.append(pa.array([x.tobytes() for x in raw], pa.binary()))
        elif c.kind == Kind.UINT64:
            out.append(pa.array([int(x) for x in raw.view("<u8").ravel()], pa.decimal128(20, 0)))
        else:
            wide = {Kind.BOOL: np.int16, Kind.UINT8: np.int16, Kind.UINT16: np.int32, Kind.UINT32: np.int64}.get(c.kind)
            cells = raw.view(NUMPY[c.kind]).ravel()
            out.append(pa.array(cells.astype(wide) if wide else cells))
    return out


def byte_copy(old: Kind, new: Kind):
    """A function of columns that keeps a cell's low bytes and fills longer cells with zero bytes."""

    def copy(cells: pd.Series) -> pd.Series:
        flat = np.frombuffer(b"".join(encode_cell(v, old) for v in cells), np.uint8).reshape(-1, WIDTH[old])
        out = np.zeros((len(flat), WIDTH[new]), np.uint8)
        both = min(WIDTH[old], WIDTH[new])
        out[:, :both] = flat[:, :both]
        return decode_rows(out, (ColumnSpec("cell", new),))[0].to_pandas()

    return F.pandas_udf(copy, SPARK[new])


def encode_cell(value, kind: Kind) -> bytes:
    if kind == Kind.GUID:
        return bytes(value)
    return struct.pack("<" + np.dtype(NUMPY[kind]).char.replace("l", "q").replace("L", "Q"), value if kind in (Kind.FLOAT, Kind.DOUBLE) else int(value))


def _meta(row: Expr) -> list[Expr]:
    return [row.alias("_row"), F.lit(False).alias("_valid"), F.lit(False).alias("_locked"), F.lit(0).cast("smallint").alias("_level")]


def _at(rows: int | Expr) -> Expr:
    return rows if isinstance(rows, Expr) else F.col("_row") == F.lit(rows)


@dataclass
class Catalog:
    """Stores by tag, and the store and place of each column; the last of equal tags wins."""

    stores: list[Store] = field(default_factory=list)
    version: int = 1

    def add(self, store: Store) -> Catalog:
        self.stores.append(store)
        return self

    def store_index(self, tag: str) -> int | None:
        return next((i for i in range(len(self.stores) - 1, -1, -1) if self.stores[i].tag == tag), None)

    def column_index(self, name: str) -> tuple[int, int] | None:
        for i in range(len(self.stores) - 1, -1, -1):
            for j, c in enumerate(self.stores[i].columns):
                if c.name == name:
                    return i, j
        return None


def table_store(spark: SparkSession, sf_dir: str, name: str, key: str, columns: Iterable[ColumnSpec] | None = None, **options) -> Store:
    """A store over a parquet table with a dense key."""
    return Store.from_frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key, columns, tag=name, **options)
