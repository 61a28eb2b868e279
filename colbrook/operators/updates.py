"""Conditional column updates described as data.

An update writes one column of the rows that are alive, inside its level band and match its
condition: target = target OP right side. The right side is a constant, a column, a scaled
column, a column through a response curve, noise, noise scaled by a column, or the index of the
greatest of several columns. An update is a projection; a list of updates folds into one plan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import BITWISE, Cmp, Curve, Noise, Op, argmax, compare, operate
from ..functions.kinds import FLOATING, SPARK, Kind, from_number, literal, wrapping
from ..sources.store import Store

ALL_LEVELS = (0, 255)
#: Most columns an argmax chooses from.
MAX_CHOICES = 64


@dataclass(frozen=True)
class When:
    """A condition on a column; `typed` asks for a column of another kind than the target's."""

    column: str
    cmp: Cmp
    value: float
    typed: bool = False


@dataclass(frozen=True)
class Update:
    target: str
    op: Op = Op.SET
    value: float = 0
    operand: str | None = None
    scale: float | None = None
    curve: Curve | None = None
    noise: Noise | None = None
    choices: tuple[str, ...] | None = None
    floor: float = float("-inf")
    no_choice: int = -1
    when: When | None = None
    band: tuple[int, int] = ALL_LEVELS
    store: int | str = 0

    def where(self, column: str, cmp: Cmp, value: float) -> Update:
        return replace(self, when=When(column, cmp, value))

    def where_typed(self, column: str, cmp: Cmp, value: float) -> Update:
        return replace(self, when=When(column, cmp, value, True))

    def in_band(self, low: int, high: int) -> Update:
        return replace(self, band=(low, high))

    def on(self, store: int | str) -> Update:
        return replace(self, store=store)


def scalar(target: str, op: Op, value: float) -> Update:
    return Update(target, op, value)


def column(target: str, op: Op, operand: str) -> Update:
    return Update(target, op, operand=operand)


def scaled(target: str, op: Op, operand: str, scale: float) -> Update:
    return Update(target, op, operand=operand, scale=scale)


def curved(target: str, op: Op, operand: str, curve: Curve) -> Update:
    return Update(target, op, operand=operand, curve=curve)


def noisy(target: str, op: Op, noise: Noise) -> Update:
    return Update(target, op, noise=noise)


def perturbed(target: str, op: Op, operand: str, noise: Noise) -> Update:
    return Update(target, op, operand=operand, noise=noise)


def choose(target: str, choices: Iterable[str], floor: float = float("-inf"), no_choice: int = -1) -> Update:
    return Update(target, choices=tuple(choices), floor=floor, no_choice=no_choice)


def valid_for(store: Store, u: Update) -> bool:
    """Whether every column it names exists; an update that names others does nothing."""
    names = [u.target, *([u.operand] if u.operand else []), *([u.when.column] if u.when else []), *(u.choices or ())]
    return all(store.spec(n) for n in names) and len(u.choices or ()) <= MAX_CHOICES


def applies(store: Store, u: Update, strict_compat: bool = False) -> Expr:
    """Alive, in the band, and matching.

    Unknown comparisons, and typed conditions on columns of other kinds, raise; with strict_compat
    every row passes them.
    """
    hit = F.col("_valid")
    if u.band != ALL_LEVELS:
        hit = hit & F.col("_level").between(*u.band)
    if u.when and u.choices is None:
        kind = store.spec(u.when.column).kind
        target = store.spec(u.target).kind
        if u.when.cmp not in iter(Cmp):
            if strict_compat:
                return hit
            raise ValueError(f"no comparison {u.when.cmp}")
        if u.when.typed and kind not in (Kind.INT32, Kind.FLOAT):
            if strict_compat:
                return hit
            raise ValueError("a typed condition reads an INT32 or FLOAT column")
        if not u.when.typed and kind != target:
            raise ValueError(f"condition column {u.when.column} is {kind.name}, target is {target.name}: use a typed condition")
        hit = hit & compare(u.when.cmp, F.col(u.when.column), literal(u.when.value, kind), kind)
    return hit


def right_side(store: Store, u: Update, strict_compat: bool, precision: str) -> Expr:
    kind = store.spec(u.target).kind
    banded = u.band != ALL_LEVELS
    if banded and (u.curve or u.scale is not None) and not strict_compat:
        raise ValueError("a curve or scale cannot be combined with a level band")
    if u.noise:
        if u.op in BITWISE:
            return F.col(u.target)
        n = F.col("__noise")
        return from_number((F.col(u.operand).cast("float") * n).cast("float") if u.operand else n, kind)
    if u.operand is None:
        return literal(u.value, kind)
    if store.spec(u.operand).kind != kind and not u.curve:
        raise ValueError(f"operand {u.operand} is {store.spec(u.operand).kind.name}, target is {kind.name}")
    x = F.col(u.operand)
    if u.curve and not banded:
        return from_number(u.curve.of(x, precision), kind)
    if u.scale is not None and not banded:
        if kind in FLOATING:
            return (x * literal(u.scale, kind)).cast(SPARK[kind])
        return operate(Op.MUL, x, literal(u.scale, kind), kind)
    return x


def fold(store: Store, updates: Iterable[Update], strict_compat: bool = False, precision: str = "float", count: bool = False) -> tuple[DataFrame, list[str]]:
    """The store's frame after all updates in order; neighbours that do not meet share a projection.

    With count, every update also leaves a column that flags its rows; their names come second.

    With strict_compat an update with curve or scale in a level band runs as a plain column
    update, an unknown operation changes nothing (its rows count), and what `applies` says;
    otherwise these raise.
    """
    hits: list[str] = []
    with wrapping(store.frame.sparkSession):
        frame, names = store.frame, list(store.frame.columns)
        changed: dict[str, Expr] = {}
        flags: list[Expr] = []

        def flush() -> None:
            """Projects what has gathered: updates that read nothing another of them writes."""
            nonlocal frame
            if changed or flags:
                frame = frame.select(*[changed[n].alias(n) if n in changed else F.col(n) for n in names], *flags)
                names.extend(f"__hit{i}" for i in range(len(hits) - len(flags), len(hits)))
                changed.clear()
                flags.clear()

        for u in updates:
            if not valid_for(store, u):
                continue
            kind = store.spec(u.target).kind
            if u.noise or {u.target, u.operand, u.when and u.when.column, *(u.choices or ())} & changed.keys():
                flush()
            if u.noise:
                frame = u.noise.stage(frame, "_row", "__noise")
            if u.choices is not None:
                if kind != Kind.INT32:
                    raise ValueError("a choice is written to an INT32 column")
                new = argmax([(F.col(c), store.spec(c).kind) for c in u.choices], u.floor, u.no_choice)
                flag = applies(store, replace(u, when=None), strict_compat)
            else:
                right = right_side(store, u, strict_compat, precision)
                if u.op not in iter(Op) and not strict_compat:
                    raise ValueError(f"no operation {u.op}")
                same = u.op not in iter(Op) or u.noise and u.op in BITWISE
                new = F.col(u.target) if same else operate(u.op, F.col(u.target), right, kind)
                flag = applies(store, u, strict_compat)
            changed[u.target] = F.when(flag, new).otherwise(F.col(u.target))
            if count:
                flags.append(flag.alias(f"__hit{len(hits)}"))
                hits.append(f"__hit{len(hits)}")
            if u.noise:
                flush()
        flush()
    return frame, hits


def apply(store: Store, *updates: Update, strict_compat: bool = False, precision: str = "float") -> Store:
    """The next version, lazily."""
    return store.updated(fold(store, updates, strict_compat, precision)[0])


def affected(store: Store, *updates: Update, strict_compat: bool = False) -> int:
    """Rows written, added up over the updates, in one job."""
    frame, hits = fold(store, updates, strict_compat, count=True)
    if not hits:
        return 0
    total = frame.agg(sum((F.coalesce(F.sum(F.col(h).cast("long")), F.lit(0)) for h in hits), F.lit(0)).alias("n"))
    return int(total.head()[0])
