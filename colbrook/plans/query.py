"""Declarative queries and upserts as data: filters, joins, expressions, grouping, sorting, limits.

Objects of this module describe a query; `Query.build` compiles it to one DataFrame plan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- expressions -----------------------------------------------------------------------------

#: Operators of two operands. Division gives a double unless the result type is whole.
BINARY = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "has": lambda a, b: a.bitwiseAND(b) == b, "lacks": lambda a, b: a.bitwiseAND(b) == F.lit(0),
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a.cast("double") / b, "mod": lambda a, b: a % b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b,
    "bitand": lambda a, b: a.bitwiseAND(b), "bitor": lambda a, b: a.bitwiseOR(b), "bitxor": lambda a, b: a.bitwiseXOR(b),
}
UNARY = {"neg": lambda a: -a, "not": lambda a: ~a}
AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


class Node:
    def expr(self) -> Expr:
        raise NotImplementedError


@dataclass(frozen=True)
class Ref(Node):
    column: str

    def expr(self) -> Expr:
        return F.col(self.column)


@dataclass(frozen=True)
class Const(Node):
    value: object

    def expr(self) -> Expr:
        return F.lit(self.value)


@dataclass(frozen=True)
class Unary(Node):
    op: str
    of: Node

    def expr(self) -> Expr:
        return UNARY[self.op](self.of.expr())


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    result: str | None = None

    def expr(self) -> Expr:
        a, b = self.left.expr(), self.right.expr()
        if self.op == "div" and self.result in ("int", "bigint", "long"):
            q = a.cast("double") / b
            return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast(self.result)
        out = BINARY[self.op](a, b)
        return out.cast(self.result) if self.result else out


@dataclass(frozen=True)
class Aggregate(Node):
    """sum, sumif (with a condition), count, min, max or avg."""

    op: str
    of: Node
    name: str
    when: Node | None = None

    def expr(self) -> Expr:
        x = self.of.expr()
        if self.op == "sumif":
            return F.coalesce(F.sum(F.when(self.when.expr(), x)), F.lit(0)).alias(self.name)
        return AGGREGATES[self.op](x).alias(self.name)


# -- predicates ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    """column OP constant or other column; range has two bounds; not/and/or/xor take parts."""

    op: str
    column: str | None = None
    value: object = None
    other: str | None = None
    high: object = None
    parts: tuple[Test, ...] = ()

    def expr(self) -> Expr:
        if self.op in ("and", "or", "xor", "not"):
            parts = [p.expr() for p in self.parts]
            if self.op == "not":
                return ~_all(parts)
            out = parts[0]
            for p in parts[1:]:
                out = BINARY[self.op](out, p)
            return out
        a = F.col(self.column)
        if self.op == "range":
            hit = a.between(self.value, self.high)
        else:
            hit = BINARY[self.op](a, F.col(self.other) if self.other else F.lit(self.value))
        return F.coalesce(hit, F.lit(False))


def _all(parts: list[Expr]) -> Expr:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


# -- queries ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class EquiJoin:
    store: str
    left: str
    right: str


@dataclass(frozen=True)
class Sort:
    by: str | Node
    ascending: bool = True


@dataclass(frozen=True)
class Query:
    source: str
    columns: tuple[str, ...] = ()
    joins: tuple[EquiJoin, ...] = ()
    where: tuple[Test, ...] = ()
    calculated: tuple[tuple[str, Node], ...] = ()
    group: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    #: Calculated from group columns and aggregates, after grouping.
    group_calculated: tuple[tuple[str, Node], ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int = 0
    select_all: bool = False

    def build(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        df = tables[self.source]
        for j in self.joins:
            right = tables[j.store]
            df = df.join(right, df[j.left] == right[j.right], "inner")
        if self.where:
            df = df.where(_all([t.expr() for t in self.where]))
        for name, node in self.calculated:
            df = df.withColumn(name, node.expr())
        if self.aggregates or self.group:
            df = df.groupBy(*self.group).agg(*[a.expr() for a in self.aggregates]) if self.aggregates else df.select(*self.group).distinct()
            for name, node in self.group_calculated:
                df = df.withColumn(name, node.expr())
        if self.sort:
            keys = [(s.by.expr() if isinstance(s.by, Node) else F.col(s.by)) for s in self.sort]
            df = df.orderBy(*[k.asc_nulls_first() if s.ascending else k.desc_nulls_last() for k, s in zip(keys, self.sort)])
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        if self.columns and not self.select_all:
            df = df.select(*self.columns)
        return df


# -- updates ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Upsert:
    """Rows of a source table into a target by key.

    joins: tables that the source is joined with first. insert: rows whose key is missing are added (with insert_if_not_exists); update: rows whose
    key exists take the assigned values (update_if_exists); delete: rows that `removed` marks in
    the source are dropped from the target (delete_if_removed).
    """

    key: str
    assign: tuple[tuple[str, Node], ...] = ()
    insert_if_not_exists: bool = True
    update_if_exists: bool = True
    delete_if_removed: bool = False
    removed: Test | None = None
    joins: tuple[EquiJoin, ...] = ()

    def build(self, target: DataFrame, source: DataFrame, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """The target's columns after the update; names of source columns begin with new_."""
        if self.joins:
            source = Query("", joins=self.joins).build({**(tables or {}), "": source})
        s = source.select(*[F.col(c).alias(f"new_{c}") for c in source.columns], F.lit(True).alias("__new"))
        t = target.withColumn("__old", F.lit(True))
        both = t.join(s, t[self.key] == s[f"new_{self.key}"], "full" if self.insert_if_not_exists else "left")
        old, new = F.coalesce("__old", F.lit(False)), F.coalesce("__new", F.lit(False))
        if self.delete_if_removed and self.removed:
            gone = new & replace(self.removed, column=f"new_{self.removed.column}").expr()
            both = both.where(~gone)
        assigned = dict(self.assign)
        cells = []
        for c in target.columns:
            given = assigned[c].expr() if c in assigned else (F.col(f"new_{c}") if f"new_{c}" in both.columns else F.lit(None))
            kept = F.when(new & F.lit(self.update_if_exists), given).otherwise(F.col(c)) if c in assigned else F.col(c)
            fresh = F.col(f"new_{c}") if f"new_{c}" in both.columns else F.lit(None)
            cells.append(F.when(old, kept).otherwise(fresh).cast(target.schema[c].dataType).alias(c))
        return both.select(*cells)


@dataclass(frozen=True)
class Assign:
    """Set columns of the rows that match, optionally only the first `limit` in sort order.

    `key` names a unique column, needed only with a limit.
    """

    values: tuple[tuple[str, Node], ...]
    where: tuple[Test, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int = 0
    key: str | None = None

    def build(self, target: DataFrame) -> DataFrame:
        hit = _all([t.expr() for t in self.where])
        rows = target
        if self.limit is not None:
            chosen = Query("t", (self.key,), where=self.where, sort=self.sort, limit=self.limit, offset=self.offset).build({"t": target})
            chosen = chosen.select(F.col(self.key).alias("__key"))
            rows = target.join(chosen, target[self.key] == chosen["__key"], "left").withColumn("__hit", F.col("__key").isNotNull())
            hit = F.col("__hit")
        values = dict(self.values)
        return rows.select(*[F.when(hit, values[c].expr().cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


@dataclass(frozen=True)
class Delete:
    where: tuple[Test, ...]

    def build(self, target: DataFrame) -> DataFrame:
        return target.where(~_all([t.expr() for t in self.where]))


# -- registry --------------------------------------------------------------------------------


@dataclass
class ViewEntry:
    """A named query with a refresh rate: 0 off, 255 on every call, else times a second.

    insert, update and delete say what writing through the view does to the query's source.
    """

    query: Query
    frequency: int = 0
    dirty: bool = True
    last: float = float("-inf")
    result: DataFrame | None = None
    insert: Upsert | None = None
    update: Assign | None = None
    delete: Delete | None = None


@dataclass
class Registry:
    views: dict[str, ViewEntry] = field(default_factory=dict)

    def register(self, name: str, query: Query, frequency: int = 0, insert: Upsert | None = None, update: Assign | None = None, delete: Delete | None = None) -> None:
        self.views[name] = ViewEntry(query, frequency, insert=insert, update=update, delete=delete)

    def write(self, name: str, tables: Mapping[str, DataFrame], new: DataFrame | None = None) -> dict[str, DataFrame]:
        """The tables after the view's delete, update and (of the rows `new`) insert; views over them are dirty."""
        v = self.views[name]
        target = tables[v.query.source]
        target = v.delete.build(target) if v.delete else target
        target = v.update.build(target) if v.update else target
        target = v.insert.build(target, new, tables) if v.insert and new is not None else target
        for other in self.views.values():
            if v.query.source in (other.query.source, *(j.store for j in other.query.joins)):
                other.dirty = True
        return {**tables, v.query.source: target}

    def mark_dirty(self, name: str) -> None:
        self.views[name].dirty = True

    def due(self, name: str, now: float) -> bool:
        v = self.views[name]
        return v.frequency == 255 or v.frequency > 0 and now - v.last >= 1 / v.frequency

    def refresh(self, tables: Mapping[str, DataFrame], now: float) -> list[str]:
        """Builds the due and dirty views anew; returns their names."""
        done = []
        for name, v in self.views.items():
            if v.dirty and self.due(name, now):
                v.result, v.last, v.dirty = v.query.build(tables), now, False
                done.append(name)
        return done
