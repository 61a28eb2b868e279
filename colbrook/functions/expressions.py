"""Column expressions of the update kernels: operations, comparisons, curves, noise, argmax.

All are built-in Spark expressions and stay inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinds import FLOATING, TWO64, Kind, as_bits, from_bits, literal, wrap


class Op(IntEnum):
    SET = 0
    ADD = 1
    SUB = 2
    MUL = 3
    MIN = 4
    MAX = 5
    AND = 6
    OR = 7
    XOR = 8
    AND_NOT = 9


class Cmp(IntEnum):
    ALWAYS = 0
    EQ = 1
    NE = 2
    LT = 3
    LE = 4
    GT = 5
    GE = 6
    HAS_ALL = 7
    HAS_ANY = 8
    LACKS = 9


class Shape(IntEnum):
    LINEAR = 0
    POWER = 1
    SMOOTHSTEP = 2
    THRESHOLD = 3


BITWISE = (Op.AND, Op.OR, Op.XOR, Op.AND_NOT)
BIT_TESTS = (Cmp.HAS_ALL, Cmp.HAS_ANY, Cmp.LACKS)


def operate(op: Op, cur: Column, rhs: Column, kind: Kind) -> Column:
    """cur OP rhs as a cell of the kind; both are cells of that kind.

    INT64 sums and products wrap only in plans analysed under `wrapping`.
    """
    if op == Op.SET:
        return rhs
    if op in (Op.MIN, Op.MAX):
        return F.when(less(cur, rhs, kind) if op == Op.MIN else less(rhs, cur, kind), cur).otherwise(rhs)
    if op in BITWISE:
        if kind in FLOATING:
            return cur
        a, b = as_bits(cur, kind), as_bits(rhs, kind)
        out = {Op.AND: a.bitwiseAND(b), Op.OR: a.bitwiseOR(b), Op.XOR: a.bitwiseXOR(b), Op.AND_NOT: a.bitwiseAND(F.bitwise_not(b))}[op]
        return from_bits(out, kind)
    if kind in FLOATING:
        return (cur + rhs if op == Op.ADD else cur - rhs if op == Op.SUB else cur * rhs).cast("float" if kind == Kind.FLOAT else "double")
    if kind == Kind.UINT64 or kind == Kind.UINT32 and op == Op.MUL:
        a, b = cur.cast("decimal(38,0)"), rhs.cast("decimal(38,0)")
        if op == Op.MUL and kind == Kind.UINT64:
            whole, base = F.lit(str(TWO64)).cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)")
            low, high = F.pmod(b, base), F.floor(b / base).cast("decimal(38,0)")
            return wrap(F.pmod((a * low).cast("decimal(38,0)"), whole) + F.pmod((F.pmod((a * high).cast("decimal(38,0)"), whole) * base).cast("decimal(38,0)"), whole), kind)
        out = a + b if op == Op.ADD else a - b if op == Op.SUB else (a * b).cast("decimal(38,0)")
        return wrap(F.pmod(out.cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)")) if kind == Kind.UINT32 else out, kind)
    a, b = cur.cast("bigint"), rhs.cast("bigint")
    return wrap(a + b if op == Op.ADD else a - b if op == Op.SUB else a * b, kind)


def _no_nan(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & ~F.isnan(c)
    return out


def less(a: Column, b: Column, kind: Kind) -> Column:
    return (a < b) & _no_nan(a, b) if kind in FLOATING else a < b


def compare(cmp: Cmp, a: Column, b: Column, kind: Kind) -> Column:
    """Two-valued comparison with IEEE rules: every test but NE is false on NaN."""
    if cmp == Cmp.ALWAYS:
        return F.lit(True)
    if cmp in BIT_TESTS:
        if kind in FLOATING:
            return F.lit(False)
        a, b = as_bits(a, kind), as_bits(b, kind)
        hit = a.bitwiseAND(b)
        return hit == b if cmp == Cmp.HAS_ALL else hit != F.lit(0) if cmp == Cmp.HAS_ANY else hit == F.lit(0)
    if cmp == Cmp.NE:
        return (a != b) | ~_no_nan(a, b) if kind in FLOATING else a != b
    out = {Cmp.EQ: a == b, Cmp.LT: a < b, Cmp.LE: a <= b, Cmp.GT: a > b, Cmp.GE: a >= b}[cmp]
    return out & _no_nan(a, b) if kind in FLOATING else out


@dataclass(frozen=True)
class Curve:
    """Response curve over [low, high]; p0 and p1 by shape (slope, offset; exponent; step)."""

    shape: Shape = Shape.LINEAR
    low: float = 0.0
    high: float = 1.0
    p0: float = 1.0
    p1: float = 0.0
    invert: bool = False

    def of(self, raw: Column, precision: str = "float") -> Column:
        """The curve's value in [0, 1], in float32 unless asked in double."""
        n = lambda v: F.lit(float(v)).cast(precision)
        clamp = lambda y: F.when(y < n(0), n(0)).when(y > n(1), n(1)).otherwise(y)
        raw = raw.cast(precision)
        x = clamp((raw - n(self.low)) / (n(self.high) - n(self.low))).cast(precision) if self.high > self.low else n(0)
        if self.shape == Shape.LINEAR:
            y = n(self.p0) * x + n(self.p1)
        elif self.shape == Shape.POWER:
            y = n(1)
            for _ in range(min(16, max(0, int(self.p0)))):
                y = y * x
        elif self.shape == Shape.SMOOTHSTEP:
            y = x * x * (n(3) - n(2) * x)
        else:
            y = F.when(x >= n(self.p0), n(1)).otherwise(n(0))
        y = clamp(y)
        return (n(1) - y if self.invert else y).cast(precision)


# The increment and multipliers of SplitMix64, as signed 64-bit numbers.
GOLDEN, MIX1, MIX2 = -7046029254386353131, -4658895280553007687, -7723592293110705685


def split_mix(z: Column) -> Column:
    """SplitMix64 of a bigint read as 64 bits; build it inside `wrapping`."""
    z = z + F.lit(GOLDEN)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * F.lit(MIX1)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * F.lit(MIX2)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def staged_split_mix(df: DataFrame, name: str) -> DataFrame:
    """Replaces a bigint column by its SplitMix64, one projection a step.

    Each step names its input twice; kept apart, the plan stays small and is still one stage of
    generated code. Build it inside `wrapping`.
    """
    z = F.col(name)
    df = df.withColumn(name, z + F.lit(GOLDEN))
    df = df.withColumn(name, z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * F.lit(MIX1))
    df = df.withColumn(name, z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * F.lit(MIX2))
    return df.withColumn(name, z.bitwiseXOR(F.shiftrightunsigned(z, 31)))


def split_mix_number(z: int) -> int:
    mask = TWO64 - 1
    z = (z + GOLDEN) & mask
    z = ((z ^ z >> 30) * (MIX1 & mask)) & mask
    z = ((z ^ z >> 27) * (MIX2 & mask)) & mask
    return z ^ z >> 31


def signed64(x: int) -> int:
    x &= TWO64 - 1
    return x - TWO64 if x >> 63 else x


@dataclass(frozen=True)
class Noise:
    """Counter-based noise in [low, high): a function of row, tick and seed, whatever the layout."""

    low: float = 0.0
    high: float = 1.0
    seed: int = 0
    tick: int = 0

    def unit(self, row: Column) -> Column:
        """float32 in [0, 1); build inside `wrapping`."""
        inner = split_mix(row.cast("bigint").bitwiseXOR(F.lit(signed64(split_mix_number(self.tick)))))
        h = split_mix(inner.bitwiseXOR(F.lit(signed64(self.seed))))
        return (F.shiftrightunsigned(h, 40).cast("float") / F.lit(16777216.0).cast("float")).cast("float")

    def _scaled(self, unit: Column) -> Column:
        low, high = (F.lit(float(v)).cast("float") for v in (self.low, self.high))
        return (low + (high - low) * unit).cast("float")

    def of(self, row: Column) -> Column:
        return self._scaled(self.unit(row))

    def stage(self, df: DataFrame, row: str, name: str) -> DataFrame:
        """The same noise as a new column, in small projections."""
        df = df.withColumn(name, F.col(row).cast("bigint").bitwiseXOR(F.lit(signed64(split_mix_number(self.tick)))))
        df = staged_split_mix(df, name)
        df = staged_split_mix(df.withColumn(name, F.col(name).bitwiseXOR(F.lit(signed64(self.seed)))), name)
        unit = (F.shiftrightunsigned(F.col(name), 40).cast("float") / F.lit(16777216.0).cast("float")).cast("float")
        return df.withColumn(name, self._scaled(unit))


def argmax(columns: list[tuple[Column, Kind]], floor: float, no_choice: int = -1) -> Column:
    """Index of the greatest column, the lowest on ties; no_choice below the floor or without columns.

    NaN never wins, and in the first place makes the result no_choice.
    """
    if not columns:
        return F.lit(no_choice).cast("int")
    (best, kind), index = columns[0], F.lit(0)
    for i, (c, _) in enumerate(columns[1:], 1):
        better = less(best, c, kind)
        index = F.when(better, F.lit(i)).otherwise(index)
        best = F.when(better, c).otherwise(best)
    return F.when(compare(Cmp.GE, best, literal(floor, kind), kind), index).otherwise(F.lit(no_choice)).cast("int")
