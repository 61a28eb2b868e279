"""Value kinds of store columns: widths, Spark types, wrap-around arithmetic, narrowing."""

from __future__ import annotations

from contextlib import contextmanager
from decimal import Decimal
from enum import IntEnum

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(IntEnum):
    """Kinds of a cell; there is no null, absence is a default value."""

    BOOL = 0
    INT8 = 1
    UINT8 = 2
    INT16 = 3
    UINT16 = 4
    INT32 = 5
    UINT32 = 6
    INT64 = 7
    UINT64 = 8
    FLOAT = 9
    DOUBLE = 10
    GUID = 11


#: Bytes of a cell, and the Spark type that holds all its values.
WIDTH = {Kind.BOOL: 1, Kind.INT8: 1, Kind.UINT8: 1, Kind.INT16: 2, Kind.UINT16: 2, Kind.INT32: 4, Kind.UINT32: 4, Kind.INT64: 8, Kind.UINT64: 8, Kind.FLOAT: 4, Kind.DOUBLE: 8, Kind.GUID: 16}
SPARK = {
    Kind.BOOL: T.ShortType(), Kind.INT8: T.ByteType(), Kind.UINT8: T.ShortType(), Kind.INT16: T.ShortType(), Kind.UINT16: T.IntegerType(), Kind.INT32: T.IntegerType(),
    Kind.UINT32: T.LongType(), Kind.INT64: T.LongType(), Kind.UINT64: T.DecimalType(20, 0), Kind.FLOAT: T.FloatType(), Kind.DOUBLE: T.DoubleType(), Kind.GUID: T.BinaryType(),
}
#: numpy's names of the kinds in row bytes.
NUMPY = {Kind.BOOL: "<u1", Kind.INT8: "<i1", Kind.UINT8: "<u1", Kind.INT16: "<i2", Kind.UINT16: "<u2", Kind.INT32: "<i4", Kind.UINT32: "<u4", Kind.INT64: "<i8", Kind.UINT64: "<u8", Kind.FLOAT: "<f4", Kind.DOUBLE: "<f8"}
FLOATING = (Kind.FLOAT, Kind.DOUBLE)
SIGNED = (Kind.INT8, Kind.INT16, Kind.INT32, Kind.INT64)
TWO64 = 1 << 64


def kind_of(dtype: T.DataType) -> Kind:
    """The kind that a Spark column has when none is declared."""
    for cls, kind in ((T.BooleanType, Kind.BOOL), (T.ByteType, Kind.INT8), (T.ShortType, Kind.INT16), (T.IntegerType, Kind.INT32), (T.LongType, Kind.INT64), (T.FloatType, Kind.FLOAT), (T.DoubleType, Kind.DOUBLE), (T.DecimalType, Kind.UINT64), (T.BinaryType, Kind.GUID)):
        if isinstance(dtype, cls):
            return kind
    raise TypeError(f"no value kind holds {dtype.simpleString()}")


@contextmanager
def wrapping(spark: SparkSession):
    """64-bit integer arithmetic wraps around in plans that are analysed inside this block."""
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def zero(kind: Kind):
    return b"\0" * 16 if kind == Kind.GUID else 0.0 if kind in FLOATING else Decimal(0) if kind == Kind.UINT64 else 0


def literal(value, kind: Kind) -> Column:
    """A constant of the kind; numbers are cut towards zero and wrapped like a cell write."""
    if kind == Kind.GUID:
        return F.lit(bytes(value))
    if kind in FLOATING:
        return F.lit(float(value)).cast(SPARK[kind])
    number = wrap_number(int(value), kind)
    return F.lit(str(number) if kind == Kind.UINT64 else number).cast(SPARK[kind])


def wrap_number(value: int, kind: Kind) -> int:
    bits = 8 * WIDTH[kind]
    value &= (1 << bits) - 1
    return value - (1 << bits) if kind in SIGNED and value >> (bits - 1) else value


def wrap(x: Column, kind: Kind) -> Column:
    """A whole number that fits 64 bits (decimal for UINT64), taken modulo the kind's width."""
    bits = 8 * WIDTH[kind]
    if kind == Kind.UINT64:
        x = x.cast("decimal(38,0)")
        return F.pmod(x, F.lit(str(TWO64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    if kind == Kind.INT64:
        return x
    x = x.cast("bigint")
    mask = F.lit((1 << bits) - 1).cast("bigint")
    if kind in SIGNED:
        half = F.lit(1 << (bits - 1)).cast("bigint")
        return ((x + half).bitwiseAND(mask) - half).cast(SPARK[kind])
    return x.bitwiseAND(mask).cast(SPARK[kind])


def as_bits(x: Column, kind: Kind) -> Column:
    """The cell as a bigint with the same low bits."""
    if kind == Kind.UINT64:
        return F.when(x >= F.lit(str(1 << 63)).cast("decimal(20,0)"), (x - F.lit(str(TWO64)).cast("decimal(38,0)"))).otherwise(x).cast("bigint")
    return x.cast("bigint")


def from_bits(x: Column, kind: Kind) -> Column:
    if kind == Kind.UINT64:
        wide = x.cast("decimal(38,0)")
        return F.when(x < 0, wide + F.lit(str(TWO64)).cast("decimal(38,0)")).otherwise(wide).cast("decimal(20,0)")
    return wrap(x, kind)


def from_number(x: Column, kind: Kind) -> Column:
    """A floating number stored as the kind: cut towards zero for whole kinds."""
    if kind in FLOATING:
        return x.cast(SPARK[kind])
    if kind == Kind.UINT64:
        return wrap(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("decimal(38,0)"), kind)
    return wrap(x.cast("bigint"), kind)


def smallest_unsigned(high: int) -> Kind:
    """The narrowest unsigned kind that holds 0..high."""
    return next(k for k in (Kind.UINT8, Kind.UINT16, Kind.UINT32, Kind.UINT64) if high < 1 << 8 * WIDTH[k])


def smallest_signed(low: int, high: int) -> Kind:
    """The narrowest signed kind that holds low..high."""
    return next(k for k in SIGNED if -(1 << 8 * WIDTH[k] - 1) <= low and high < 1 << 8 * WIDTH[k] - 1)


def convert_cell(x: Column, old: Kind, new: Kind) -> Column:
    """Schema migration by bytes: low bytes kept, longer cells filled with zero bytes.

    Whole kinds only (a negative number widens as its unsigned bits); equal kinds pass. Reading
    the bytes of a float as a whole number has no meaning here and raises.
    """
    if old == new:
        return x
    if Kind.GUID in (old, new) or old in FLOATING or new in FLOATING:
        raise TypeError(f"{old.name} bytes cannot be read as {new.name}")
    bits = as_bits(x, old)
    if WIDTH[old] < 8:
        bits = bits.bitwiseAND(F.lit((1 << 8 * WIDTH[old]) - 1).cast("bigint"))
    return from_bits(bits, new)


def convert_number(x: Column, old: Kind, new: Kind) -> Column:
    """Numeric conversion inside the whole kinds or inside the floating kinds; GUID to itself.

    Whole to floating is done by value, where some engines leave a zero.
    """
    if old == new:
        return x
    if Kind.GUID in (old, new):
        raise TypeError(f"{old.name} is not a number")
    if new in FLOATING:
        return x.cast(SPARK[new])
    if old in FLOATING:
        return from_number(x, new)
    return from_bits(as_bits(x, old), new)
