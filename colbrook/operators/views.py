"""Read-only snapshots and read/write views over stores.

A view reads live rows of a base store that pass its scope, joins other stores by row index
(aligned: same row; dereference: a base column holds the row), keeps the rows that pass a
predicate program, and projects columns. Absent joined rows keep the view row with zeros.
Changes are collected as row states and written back by `commit`, which gives new versions of
the stores.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Cmp, compare
from ..functions.kinds import FLOATING, SIGNED, SPARK, WIDTH, Kind, as_bits, literal, zero
from ..functions.ranks import ranked
from ..sources.shared import delete_tables, write_table
from ..sources.store import Store

#: Index value that means no row.
ABSENT = 0x7FFFFFFF
UNCHANGED, MODIFIED, NEW, REMOVED = 0, 1, 2, 3
STACK = 64
#: Most new rows for which only as many free slots are looked up.
TOP_SLOTS = 100_000


# -- snapshots -------------------------------------------------------------------------------


def snapshot(store: Store, columns: list[str], band: tuple[int, int] | None = None) -> DataFrame:
    """_row and the selected columns, in the given order, of live rows; unknown columns are dropped."""
    live = store.live()
    if band:
        live = live.where(F.col("_level").between(*band))
    return live.select("_row", *[c for c in columns if store.spec(c)])


# -- predicates ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """A test of a column of a source (0: base, k: the k-th join). RANGE has a second bound."""

    source: int
    column: str
    cmp: Cmp | str
    value: float
    high: float = 0


AND, OR, NOT, RANGE = "AND", "OR", "NOT", "RANGE"


def row_index(x: Expr, kind: Kind) -> Expr:
    """A cell that holds a row number: its bytes without a sign, so that -1 of INT8 is row 255."""
    if kind in FLOATING or kind == Kind.GUID:
        raise TypeError(f"a {kind.name} cell cannot hold a row index")
    bits = as_bits(x, kind)
    return bits.bitwiseAND(F.lit((1 << 8 * WIDTH[kind]) - 1).cast("bigint")) if kind in SIGNED and WIDTH[kind] < 8 else bits


def view_compare(cmp: Cmp | int, x: Expr, value, kind: Kind, strict_compat: bool = False) -> Expr:
    """Whole kinds compare as 64-bit signed numbers, floating ones as doubles.

    An unknown comparison raises; with strict_compat no row passes it.
    """
    if cmp not in iter(Cmp):
        if strict_compat:
            return F.lit(False)
        raise ValueError(f"no comparison {cmp}")
    if kind in FLOATING:
        return compare(cmp, x.cast("double"), F.lit(float(value)), Kind.DOUBLE)
    if kind == Kind.GUID:
        x, kind = F.lit(0), Kind.INT64
    return compare(cmp, as_bits(x, kind), F.lit(int(value)).cast("bigint"), Kind.INT64)


def view_range(x: Expr, low, high, kind: Kind) -> Expr:
    """low <= x <= high; with high < low whole numbers wrap: all outside the gap between them."""
    if kind in FLOATING:
        x = x.cast("double")
        return (x >= float(low)) & (x <= float(high)) & ~F.isnan(x)
    x = F.lit(0) if kind == Kind.GUID else as_bits(x, kind)
    low, high = int(low), int(high)
    return x.between(low, high) if low <= high else ~((x > high) & (x < low))


def compile_program(program: list, test) -> Expr:
    """One boolean column from postfix leaves and operators.

    Operators without operands are ignored, as is what does not fit the stack; an empty program
    passes every row.
    """
    stack: list[Expr] = []
    for item in program:
        if item == NOT:
            if stack:
                stack.append(~stack.pop())
        elif item in (AND, OR):
            if len(stack) >= 2:
                b, a = stack.pop(), stack.pop()
                stack.append(a & b if item == AND else a | b)
        elif len(stack) < STACK:
            stack.append(test(item))
    return stack[-1] if stack else F.lit(True)


# -- views -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Join:
    """Aligned without a column; else the base column that holds the target's row."""

    store: str
    column: str | None = None
    absent: int = ABSENT


@dataclass(frozen=True)
class Pick:
    source: int
    column: str
    name: str | None = None

    @property
    def alias(self) -> str:
        return self.name or self.column


@dataclass(frozen=True)
class Scope:
    column: str
    cmp: Cmp
    value: float


@dataclass(frozen=True)
class Write:
    """A view column that goes to a column of a store."""

    name: str
    store: str
    column: str


@dataclass(frozen=True)
class View:
    base: str
    picks: tuple[Pick, ...]
    joins: tuple[Join, ...] = ()
    scope: tuple[Scope, ...] = ()
    program: tuple = ()
    update: tuple[Write, ...] = ()
    insert: tuple[Write, ...] = ()
    delete: tuple[str, ...] = ()
    rows: DataFrame | None = None
    strict_compat: bool = False
    #: Written tables that the rows are read from.
    pins: tuple[str, ...] = ()

    def _check(self, stores: Mapping[str, Store]) -> None:
        names = [self.base, *(j.store for j in self.joins)]
        for n in names:
            if n not in stores:
                raise KeyError(f"no store {n}")
        need = [(0, s.column) for s in self.scope] + [(0, j.column) for j in self.joins if j.column]
        need += [(p.source, p.column) for p in self.picks] + [(x.source, x.column) for x in self.program if isinstance(x, Leaf)]
        for source, column in need:
            if not 0 <= source < len(names) or not stores[names[source]].spec(column):
                raise KeyError(f"no column {column} in source {source}")

    def refresh(self, stores: Mapping[str, Store]) -> View:
        """Reads the stores anew; pending changes are gone."""
        self._check(stores)
        base = stores[self.base]
        kinds = lambda source, c: stores[[self.base, *(j.store for j in self.joins)][source]].spec(c).kind
        live = base.live()
        for s in self.scope:
            live = live.where(view_compare(s.cmp, F.col(s.column), s.value, kinds(0, s.column), self.strict_compat))
        need = lambda k: {p.column for p in self.picks if p.source == k} | {x.column for x in self.program if isinstance(x, Leaf) and x.source == k}
        rows = live.select(F.col("_row").alias("_base_row"), *[F.col(c).alias(f"s0_{c}") for c in sorted(need(0) | {j.column for j in self.joins if j.column})])
        for k, j in enumerate(self.joins, 1):
            target = stores[j.store].live().select(F.col("_row").alias(f"_join{k}_row"), *[F.col(c).alias(f"s{k}_{c}") for c in sorted(need(k))])
            if j.column is None:
                on = F.col("_base_row") == F.col(f"_join{k}_row")
            else:
                index = row_index(F.col(f"s0_{j.column}"), kinds(0, j.column))
                on = (index == F.col(f"_join{k}_row")) & (index != F.lit(j.absent))
            rows = rows.join(target, on, "left")

        def test(x: Leaf) -> Expr:
            kind, c = kinds(x.source, x.column), F.col(f"s{x.source}_{x.column}")
            hit = view_range(c, x.value, x.high, kind) if x.cmp == RANGE else view_compare(x.cmp, c, x.value, kind, self.strict_compat)
            return hit if x.source == 0 else F.coalesce(hit & F.col(f"_join{x.source}_row").isNotNull(), F.lit(False))

        if self.program:
            rows = rows.where(compile_program(list(self.program), test))
        cells = []
        for p in self.picks:
            kind, c = kinds(p.source, p.column), F.col(f"s{p.source}_{p.column}")
            cells.append((c if p.source == 0 else F.coalesce(c, literal(zero(kind), kind))).alias(p.alias))
        out = rows.select("_base_row", *[f"_join{k}_row" for k in range(1, len(self.joins) + 1)], F.lit(UNCHANGED).alias("_state"), F.lit(None).cast("bigint").alias("_new"), *cells)
        read = [stores[n].pins for n in (self.base, *(j.store for j in self.joins))]
        return replace(self, rows=out, pins=tuple(dict.fromkeys(p for pins in read for p in pins)))

    def data(self) -> DataFrame:
        """The rows with their sources and states, by base row, new rows last."""
        return self.rows.orderBy(F.col("_base_row").asc_nulls_last(), "_new")

    # -- changes -----------------------------------------------------------------------------

    def change(self, where: Expr, values: Mapping[str, Expr] | None = None, state: int = MODIFIED) -> View:
        """Sets cells of the matching rows in the view's copy, and their state.

        New rows come from `add_rows` only: they stand behind all others.
        """
        if state == NEW:
            raise ValueError("rows become new by add_rows only")
        rows = self.rows.withColumn("__at", F.coalesce(where, F.lit(False)))
        for name, v in (values or {}).items():
            rows = rows.withColumn(name, F.when(F.col("__at"), v.cast(self.rows.schema[name].dataType)).otherwise(F.col(name)))
        return replace(self, rows=rows.withColumn("_state", F.when(F.col("__at"), F.lit(state)).otherwise(F.col("_state"))).drop("__at"))

    def remove(self, where: Expr) -> View:
        return self.change(where, state=REMOVED)

    def add_rows(self, new: DataFrame, order: str) -> View:
        """Appends rows with state New and no sources; `order` is a unique whole number that
        says which of them takes the lowest free slot."""
        cells = []
        for p in self.picks:
            dtype = self.rows.schema[p.alias].dataType
            cells.append((F.coalesce(F.col(p.alias).cast(dtype), F.lit(0).cast(dtype)) if p.alias in new.columns else F.lit(0).cast(dtype)).alias(p.alias))
        nothing = [F.lit(None).cast("bigint").alias(c) for c in ("_base_row", *(f"_join{k}_row" for k in range(1, len(self.joins) + 1)))]
        add = new.select(*nothing, F.lit(NEW).alias("_state"), F.col(order).cast("bigint").alias("_new"), *cells)
        return replace(self, rows=self.rows.unionByName(add))

    def _source(self, store: str) -> Expr | None:
        """The row a view row has in a store: the base, else the first join with that store."""
        if store == self.base:
            return F.col("_base_row")
        return next((F.col(f"_join{k}_row") for k, j in enumerate(self.joins, 1) if j.store == store), None)

    def commit(self, stores: Mapping[str, Store]) -> tuple[dict[str, Store], View]:
        """The stores with all changes written, and the view with the rows that new ones got."""
        return self.commit_counted(stores)[:2]

    def operations(self, stores: Mapping[str, Store]) -> int:
        """How many cell writes, links and deletes a commit does."""
        return self.commit_counted(stores)[2]

    def commit_counted(self, stores: Mapping[str, Store]) -> tuple[dict[str, Store], View, int]:
        """A commit, and how many cell writes, links and deletes it did.

        One pass in view-row order: of several rows that write one cell the last wins; a row that
        dies frees its slot for the new rows, which are last. As cells outlive their row and new
        rows begin from defaults, that is all deletes, then all updates, then all inserts. States
        stay until the next refresh.

        The changed rows are computed and written once; everything else reads that table, so that
        a store's plan does not hold the view's, nor a view's plan its own twice.
        """
        out, done = dict(stores), 0
        changes, path = write_table(self.rows.where(F.col("_state") != UNCHANGED), "changes")
        removed, modified = changes.where(F.col("_state") == REMOVED), changes.where(F.col("_state") == MODIFIED)
        tally = {"new": F.count_if(F.col("_state") == NEW)}
        for i, (state, store) in enumerate([*((REMOVED, s) for s in self.delete), *((MODIFIED, w.store) for w in self.update)]):
            if (source := self._source(store)) is not None:
                tally[f"n{i}"] = F.count_if((F.col("_state") == state) & source.isNotNull())
        counts = changes.agg(*[c.alias(n) for n, c in tally.items()]).first().asDict()
        new = counts.pop("new")
        for store in self.delete:
            if (source := self._source(store)) is not None:
                out[store] = replace(out[store].free(removed.where(source.isNotNull()).select(source.alias("__dead"))), pins=(*out[store].pins, path))
        for store in dict.fromkeys(w.store for w in self.update):
            if (source := self._source(store)) is not None:
                out[store] = replace(self._update(out[store], modified.where(source.isNotNull()), store, source), pins=(*out[store].pins, path))
        view = self
        if self.insert and new:
            out, view, done = self._insert(out, changes.where(F.col("_state") == NEW), new)
        if not any(path in s.pins for s in out.values()):
            delete_tables(changes.sparkSession, [path])
        return out, view, done + sum(counts.values())

    def _update(self, target: Store, rows: DataFrame, store: str, source: Expr) -> Store:
        writes = {w.column: w.name for w in self.update if w.store == store}
        edits = rows.groupBy(source.alias("__row")).agg(*[F.max_by(F.col(n), F.col("_base_row")).alias(f"__{c}") for c, n in writes.items()])
        joined = target.frame.join(edits, target.frame["_row"] == edits["__row"], "left")
        cells = [F.coalesce(F.col(f"__{c.name}").cast(SPARK[c.kind]), F.col(c.name)).alias(c.name) if c.name in writes else F.col(c.name) for c in target.columns]
        return target._next(joined.select("_row", "_valid", "_locked", "_level", *cells))

    def _insert(self, stores: dict[str, Store], new: DataFrame, count: int) -> tuple[dict[str, Store], View, int]:
        targets = list(dict.fromkeys(w.store for w in self.insert))
        new = ranked(new, "_new", "__k")
        for s in targets:
            # Few new rows take the lowest free slots from a bounded top-k; many rank all free slots.
            slots = stores[s].free_slots(count if count <= TOP_SLOTS else None).select(F.col("_slot").alias(f"__slot_{s}"), F.col("_k").alias(f"__k_{s}"))
            new = new.join(slots, F.col("__k") == F.col(f"__k_{s}"), "left").drop(f"__k_{s}")
        new, path = write_table(new, "inserts")
        got = lambda *s: F.count_if(F.greatest(*[F.col(f"__slot_{x}").isNull() for x in (*s, *s)]) == F.lit(False))
        links = {j.column: j.store for j in self.joins if j.column and j.store in targets} if self.base in targets else {}
        counted = [got(w.store) for w in self.insert] + [got(self.base, t) for t in links.values()]
        done = sum(new.agg(*counted).first())
        for s in targets:
            values = {w.column: w.name for w in self.insert if w.store == s}
            rows = new.where(F.col(f"__slot_{s}").isNotNull()).withColumn("_slot", F.col(f"__slot_{s}"))
            if s == self.base:
                for c, t in links.items():
                    # A full target leaves what the insert (or the default) puts there.
                    other = F.col(values[c]).cast("bigint") if c in values else F.lit(stores[s].spec(c).initial).cast("bigint")
                    rows = rows.withColumn(f"__link_{c}", F.coalesce(F.col(f"__slot_{t}"), other))
                    values[c] = f"__link_{c}"
            stores[s] = replace(stores[s].revive(rows, values), pins=(*stores[s].pins, path))
        kept = self.rows.where(F.col("_state") != NEW)
        base = F.col(f"__slot_{self.base}") if self.base in targets else F.lit(None).cast("bigint")
        fixed = [F.coalesce(base, F.col("_base_row")).alias("_base_row")]
        for k, j in enumerate(self.joins, 1):
            fixed.append((F.coalesce(F.col(f"__slot_{j.store}"), F.col(f"_join{k}_row")) if j.store in targets else F.col(f"_join{k}_row")).alias(f"_join{k}_row"))
        rest = [c for c in self.rows.columns if not c.startswith("_base_row") and not c.startswith("_join")]
        return stores, replace(self, rows=kept.unionByName(new.select(*fixed, *rest)), pins=(*self.pins, path)), done


# -- commands --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Command:
    """One cell write; `record` names the row, or a new record by any hashable that is not a row
    number: commands with the same new record fill one freshly allocated row."""

    store: str
    column: str
    record: object
    value: object


def run_commands(stores: Mapping[str, Store], commands: list[Command]) -> tuple[dict[str, Store], dict[tuple[str, object], int]]:
    """The stores after a (driver-sized) list of commands, and the rows that new records got.

    Of several writes to one cell the last counts. New records that find their store full, and
    writes to unknown stores or columns, are skipped.
    """
    out, rows = dict(stores), {}
    for name in dict.fromkeys(c.store for c in commands if c.store in out):
        own = [c for c in commands if c.store == name]
        fresh = list(dict.fromkeys(c.record for c in own if not isinstance(c.record, int)))
        if fresh:
            slots, out[name] = out[name].allocate(len(fresh))
            rows |= {(name, r): s for r, s in zip(fresh, slots)}
        spark = out[name].frame.sparkSession
        for column in dict.fromkeys(c.column for c in own):
            spec = out[name].spec(column)
            last = {(c.record if isinstance(c.record, int) else rows.get((name, c.record))): c.value for c in own if c.column == column}
            last.pop(None, None)
            if spec and last:
                schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("value", SPARK[spec.kind])])
                out[name] = out[name].write_cells(column, spark.createDataFrame(list(last.items()), schema))
    return out, rows
