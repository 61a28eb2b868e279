"""Named queries over the driver tables, each with the DuckDB SQL that gives the same rows.

Stores over driver tables take the dense key as the row, `key % 10 <> 3` as liveness and
`key % 3` as the level.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import Cmp, Curve, Noise, Op, Shape
from .functions.kinds import Kind, convert_number, smallest_signed, smallest_unsigned
from .operators.updates import Update, affected, apply, choose, column, curved, noisy, perturbed, scalar, scaled
from .operators.views import AND, NOT, OR, RANGE, Command, Join, Leaf, Pick, Scope, View, Write, run_commands, snapshot
from .plans.program import Program
from .plans.query import Aggregate, Assign, Binary, Const, Delete, EquiJoin, Query, Ref, Registry, Sort, Test, Unary, Upsert
from .sources.shared import delete_tables
from .sources.store import ColumnSpec, Store, log_to
from .streaming.scheduler import Scheduler

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

#: Spark and SQL names of the kinds used here, for casts in the shared expressions.
SQL_TYPE = {Kind.INT32: "INT", Kind.INT64: "BIGINT", Kind.DOUBLE: "DOUBLE", Kind.FLOAT: "FLOAT", Kind.UINT8: "SMALLINT", Kind.INT16: "SMALLINT", Kind.UINT64: "DECIMAL(20,0)", Kind.UINT32: "BIGINT", Kind.INT8: "TINYINT"}

Columns = dict[str, tuple[Kind, str]]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def store_of(spark: SparkSession, sf_dir: str, table: str, key: str, columns: Columns, tag: str | None = None) -> Store:
    """A store whose columns are expressions that Spark and DuckDB read alike; no driver table has nulls."""
    df = read(spark, sf_dir, table).selectExpr(f"CAST({key} AS BIGINT) AS __key", *[f"CAST({e} AS {SQL_TYPE[k]}) AS {n}" for n, (k, e) in columns.items()])
    k = F.col("__key")
    return Store.from_frame(df, "__key", [ColumnSpec(n, kind) for n, (kind, _) in columns.items()], valid=k % 10 != 3, level=k % 3, tag=tag or table, nulls=False)


#: Digits that floating results are rounded to, on both sides.
DIGITS = 9


def shown(store: Store, *targets: str) -> DataFrame:
    cells = []
    for t in targets:
        kind = store.spec(t).kind
        cells.append((F.round(F.col(t).cast("double"), DIGITS) if kind in (Kind.FLOAT, Kind.DOUBLE) else F.col(t).cast("bigint")).alias(t.lower()))
    return store.frame.select(F.col("_row").alias("row_id"), F.col("_valid").alias("valid"), *cells)


def base_sql(table: str, key: str, columns: Columns) -> str:
    cells = ", ".join(f"CAST({e} AS {SQL_TYPE[k]}) AS {n}" for n, (k, e) in columns.items())
    return f"base AS (SELECT CAST({key} AS BIGINT) AS row_id, {key} % 10 <> 3 AS valid, {key} % 3 AS lvl, {cells} FROM {table})"


def shown_sql(columns: Columns, changed: dict[str, str]) -> str:
    cells = []
    for n, e in changed.items():
        cells.append(f"round(CAST({e} AS DOUBLE), {DIGITS}) AS {n.lower()}" if columns[n][0] in (Kind.FLOAT, Kind.DOUBLE) else f"CAST({e} AS BIGINT) AS {n.lower()}")
    return f"SELECT row_id, valid, {', '.join(cells)} FROM base"


def update_query(name: str, table: str, key: str, columns: Columns, updates: list[Update], changed: dict[str, str], double: bool = True) -> None:
    """Registers a query that applies updates, with the SQL expression of each changed column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = store_of(spark, sf_dir, table, key, columns)
        return shown(apply(store, *updates, precision="double" if double else "float"), *changed)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"WITH {base_sql(table, key, columns)} {shown_sql(columns, changed)}"


def query(oracle: str):
    def register(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# -- operations and predicates ---------------------------------------------------------------

BAL: Columns = {"bal": (Kind.DOUBLE, "c_acctbal")}
for _op, _new in (("set", "500"), ("add", "bal + 100"), ("sub", "bal - 75"), ("mul", "bal * 3"), ("min", "CASE WHEN bal < 500 THEN bal ELSE 500 END"), ("max", "CASE WHEN bal > 500 THEN bal ELSE 500 END")):
    _value = {"set": 500, "add": 100, "sub": 75, "mul": 3, "min": 500, "max": 500}[_op]
    update_query(f"sys_{_op}", "customer", "c_custkey", BAL, [scalar("bal", Op[_op.upper()], _value)], {"bal": f"CASE WHEN valid THEN {_new} ELSE bal END"})

update_query("sys_scalar_add_pred", "customer", "c_custkey", BAL, [scalar("bal", Op.ADD, 100).where("bal", Cmp.LT, 50)], {"bal": "CASE WHEN valid AND bal < 50 THEN bal + 100 ELSE bal END"})

FLAGS: Columns = {"flags": (Kind.INT32, "event_id % 16"), "hits": (Kind.INT32, "user_id % 100")}
for _op, _new in (("and", "flags & 10"), ("or", "flags | 5"), ("xor", "xor(flags, 6)"), ("and_not", "flags & ~5")):
    _value = {"and": 10, "or": 5, "xor": 6, "and_not": 5}[_op]
    update_query(f"sys_bit_{_op.replace('_', '')}", "events", "event_id", FLAGS, [scalar("flags", Op[_op.upper()], _value)], {"flags": f"CASE WHEN valid THEN {_new} ELSE flags END"})

for _cmp, _test, _name in ((Cmp.EQ, "hits = 40", "eq"), (Cmp.NE, "hits <> 40", "ne"), (Cmp.LT, "hits < 40", "lt"), (Cmp.LE, "hits <= 40", "le"), (Cmp.GT, "hits > 40", "gt"), (Cmp.GE, "hits >= 40", "ge")):
    update_query(f"sys_pred_{_name}", "events", "event_id", FLAGS, [scalar("flags", Op.SET, 99).where("hits", _cmp, 40)], {"flags": f"CASE WHEN valid AND {_test} THEN 99 ELSE flags END"})
for _cmp, _test, _name in ((Cmp.HAS_ALL, "(flags & 6) = 6", "hasall"), (Cmp.HAS_ANY, "(flags & 6) <> 0", "hasany"), (Cmp.LACKS, "(flags & 6) = 0", "lacks"), (Cmp.ALWAYS, "TRUE", "always")):
    update_query(f"sys_pred_{_name}", "events", "event_id", FLAGS, [scalar("hits", Op.ADD, 1000).where("flags", _cmp, 6)], {"hits": f"CASE WHEN valid AND {_test} THEN hits + 1000 ELSE hits END"})

# -- forms -----------------------------------------------------------------------------------

PRICE: Columns = {"price": (Kind.DOUBLE, "o_totalprice"), "cust": (Kind.DOUBLE, "o_custkey"), "cap": (Kind.DOUBLE, "o_orderkey * 40")}
update_query("sys_column_add", "orders", "o_orderkey", PRICE, [column("price", Op.ADD, "cust")], {"price": "CASE WHEN valid THEN price + cust ELSE price END"})
update_query("sys_column_clamp", "orders", "o_orderkey", PRICE, [column("price", Op.MIN, "cap")], {"price": "CASE WHEN valid AND NOT price < cap THEN cap ELSE price END"})
update_query("sys_scaled_column", "orders", "o_orderkey", PRICE, [scaled("price", Op.ADD, "cust", 0.25)], {"price": "CASE WHEN valid THEN price + cust * 0.25 ELSE price END"})
update_query("sys_lod_band", "events", "event_id", FLAGS, [scalar("hits", Op.ADD, 10).in_band(0, 1), scalar("hits", Op.SET, 7).in_band(2, 2)], {"hits": "CASE WHEN NOT valid THEN hits WHEN lvl <= 1 THEN hits + 10 ELSE 7 END"})
update_query("sys_column_lod_band", "events", "event_id", FLAGS, [column("hits", Op.ADD, "flags").in_band(1, 2)], {"hits": "CASE WHEN valid AND lvl BETWEEN 1 AND 2 THEN hits + flags ELSE hits END"})
MIXED: Columns = {"price": (Kind.DOUBLE, "p_retailprice"), "size": (Kind.INT32, "p_size"), "weight": (Kind.FLOAT, "p_size * 2")}
update_query("sys_mixed_pred_f_by_i", "part", "p_partkey", MIXED, [scalar("price", Op.ADD, -10).where_typed("size", Cmp.HAS_ANY, 2)], {"price": "CASE WHEN valid AND (size & 2) <> 0 THEN price - 10 ELSE price END"})
update_query("sys_mixed_pred_i_by_f", "part", "p_partkey", MIXED, [scalar("size", Op.SET, 0).where_typed("weight", Cmp.LT, 30)], {"size": "CASE WHEN valid AND weight < 30 THEN 0 ELSE size END"})
update_query("sys_bitwise_on_float", "part", "p_partkey", MIXED, [scalar("price", Op.OR, 7)], {"price": "price"})

# -- curves, noise, choices ------------------------------------------------------------------

SCORE: Columns = {"size": (Kind.DOUBLE, "p_size"), "score": (Kind.DOUBLE, "1"), "price": (Kind.DOUBLE, "p_retailprice")}
_X = "least(greatest((size - 5) / 40.0, 0.0), 1.0)"
_C = lambda y: f"least(greatest({y}, 0.0), 1.0)"
for _name, _curve, _y in (
    ("linear", Curve(Shape.LINEAR, 5, 45, 1, 0), _X), ("power", Curve(Shape.POWER, 5, 45, 3), f"({_X} * {_X} * {_X})"), ("smoothstep", Curve(Shape.SMOOTHSTEP, 5, 45), f"({_X} * {_X} * (3 - 2 * {_X}))"),
    ("threshold", Curve(Shape.THRESHOLD, 5, 45, 0.5), f"(CASE WHEN {_X} >= 0.5 THEN 1 ELSE 0 END)"), ("invert", Curve(Shape.LINEAR, 5, 45, 1, 0, True), f"(1 - {_X})"),
    ("slope", Curve(Shape.LINEAR, 5, 45, 2, -0.25), _C(f"2 * {_X} - 0.25")), ("degenerate", Curve(Shape.LINEAR, 5, 5), "0.0"),
):
    update_query(f"curve_{_name}", "part", "p_partkey", SCORE, [curved("score", Op.SET, "size", _curve)], {"score": f"CASE WHEN valid THEN {_y} ELSE score END"})
update_query("curve_product", "part", "p_partkey", SCORE, [curved("score", Op.SET, "size", Curve(Shape.LINEAR, 5, 45)), curved("score", Op.MUL, "price", Curve(Shape.LINEAR, 900, 2000, invert=True))], {"score": f"CASE WHEN valid THEN {_X} * (1 - least(greatest((price - 900) / 1100.0, 0.0), 1.0)) ELSE score END"})
update_query("curve_gated", "part", "p_partkey", SCORE, [curved("score", Op.SET, "size", Curve(Shape.LINEAR, 5, 45)).where("size", Cmp.GE, 25)], {"score": f"CASE WHEN valid AND size >= 25 THEN {_X} ELSE score END"})


def mix_sql(source: str, name: str, z: str) -> str:
    """SplitMix64 of column z as chained DuckDB CTEs; the result is `name.z`."""
    m = "18446744073709551616::UHUGEINT"
    times = lambda x, s, c: f"((xor({x}, {x} >> {s})::UHUGEINT * {c}::UHUGEINT) % {m})::UBIGINT"
    return (
        f"{name}_a AS (SELECT * REPLACE ((((({z})::UBIGINT)::UHUGEINT + 11400714819323198485::UHUGEINT) % {m})::UBIGINT AS z) FROM {source}), "
        f"{name}_b AS (SELECT * REPLACE ({times('z', 30, '13787848793156543929')} AS z) FROM {name}_a), "
        f"{name}_c AS (SELECT * REPLACE ({times('z', 27, '10723151780598845931')} AS z) FROM {name}_b), "
        f"{name} AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM {name}_c)"
    )


def noise_sql(table: str, key: str, columns: Columns, tick: int, seed: int, select: str) -> str:
    """`select` reads from `noisy`, where u is the float noise in [0, 1)."""
    first = f"start AS (SELECT *, {tick}::UBIGINT AS z FROM base)"
    return f"WITH {base_sql(table, key, columns)}, {first}, {mix_sql('start', 'm1', 'z')}, {mix_sql('m1', 'm2', 'xor(row_id::UBIGINT, z)')}, {mix_sql('m2', 'm3', f'xor({seed}::UBIGINT, z)')}, noisy AS (SELECT *, ((z >> 40)::FLOAT / 16777216::FLOAT)::FLOAT AS u FROM m3) {select}"


WOBBLE: Columns = {"score": (Kind.FLOAT, "value"), "variance": (Kind.FLOAT, "user_id % 5"), "pick": (Kind.INT32, "user_id")}


def _noise(name: str, updates: list[Update], target: str, tick: int, seed: int, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(apply(store_of(spark, sf_dir, "events", "event_id", WOBBLE), *updates), target)

    QUERIES[name] = run
    ORACLES[name] = noise_sql("events", "event_id", WOBBLE, tick, seed, f"SELECT row_id, valid, {sql} AS {target} FROM noisy")


_noise("noise_fill", [noisy("score", Op.SET, Noise(0.25, 0.75, 1234, 3))], "score", 3, 1234, "round(CAST(CASE WHEN valid THEN (0.25::FLOAT + 0.5::FLOAT * u)::FLOAT ELSE score END AS DOUBLE), 9)")
_noise("noise_perturb", [perturbed("score", Op.ADD, "variance", Noise(0, 1, 42, 7))], "score", 7, 42, "round(CAST(CASE WHEN valid THEN (score + (variance * u)::FLOAT)::FLOAT ELSE score END AS DOUBLE), 9)")
_noise("noise_int", [noisy("pick", Op.SET, Noise(0, 1000, 99, 7))], "pick", 7, 99, "CAST(CASE WHEN valid THEN trunc((1000::FLOAT * u)::FLOAT) ELSE pick END AS BIGINT)")

CHOICE: Columns = {"s0": (Kind.DOUBLE, "event_id % 97"), "s1": (Kind.DOUBLE, "user_id % 89"), "s2": (Kind.DOUBLE, "value"), "choice": (Kind.INT32, "-99")}
_BEST = "CASE WHEN s1 > s0 THEN CASE WHEN s2 > s1 THEN 2 ELSE 1 END WHEN s2 > s0 THEN 2 ELSE 0 END"
update_query("argmax_pick", "events", "event_id", CHOICE, [choose("choice", ("s0", "s1", "s2"))], {"choice": f"CASE WHEN valid THEN {_BEST} ELSE choice END"})
update_query("argmax_floor", "events", "event_id", CHOICE, [choose("choice", ("s0", "s1", "s2"), 60, -1)], {"choice": f"CASE WHEN NOT valid THEN choice WHEN greatest(s0, s1, s2) >= 60 THEN {_BEST} ELSE -1 END"})
TIE: Columns = {"s0": (Kind.DOUBLE, "event_id % 3"), "s1": (Kind.DOUBLE, "event_id % 2"), "s2": (Kind.DOUBLE, "1"), "choice": (Kind.INT32, "-99")}
update_query("argmax_tie", "events", "event_id", TIE, [choose("choice", ("s0", "s1", "s2"))], {"choice": f"CASE WHEN valid THEN {_BEST} ELSE choice END"})
update_query("argmax_none", "events", "event_id", TIE, [choose("choice", ())], {"choice": "CASE WHEN valid THEN -1 ELSE choice END"})

# -- programs --------------------------------------------------------------------------------

_ORDER = [scalar("flags", Op.ADD, 1), scalar("hits", Op.ADD, 1), scalar("flags", Op.MUL, 2), column("hits", Op.ADD, "flags"), scalar("flags", Op.SET, 0).where("hits", Cmp.GT, 100)]
update_query("batch_conflict_order", "events", "event_id", FLAGS, _ORDER, {"flags": "CASE WHEN NOT valid THEN flags WHEN hits + 1 + (flags + 1) * 2 > 100 THEN 0 ELSE (flags + 1) * 2 END", "hits": "CASE WHEN valid THEN hits + 1 + (flags + 1) * 2 ELSE hits END"})


@query(
    f"WITH {base_sql('events', 'event_id', FLAGS)}, c AS (SELECT c_custkey AS row_id, c_custkey % 10 <> 3 AS valid, c_acctbal AS bal FROM customer) "
    "SELECT 'events' AS source, row_id, CAST(CASE WHEN valid THEN hits + 5 ELSE hits END AS DOUBLE) AS v FROM base "
    "UNION ALL SELECT 'customer', row_id, round(CASE WHEN valid THEN (bal + 10) * 2 ELSE bal END, 4) FROM c"
)
def batch_two_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = [store_of(spark, sf_dir, "events", "event_id", FLAGS), store_of(spark, sf_dir, "customer", "c_custkey", BAL)]
    program = Program((scalar("bal", Op.ADD, 10).on(1), scalar("hits", Op.ADD, 5).on(0), scalar("bal", Op.MUL, 2).on(1), scalar("bal", Op.SET, 0).on(7)))
    out = program.run(stores)
    rows = [out[i].frame.select(F.lit(n).alias("source"), F.col("_row").alias("row_id"), F.round(F.col(c).cast("double"), 4).alias("v")) for i, n, c in ((0, "events", "hits"), (1, "customer", "bal"))]
    return rows[0].unionByName(rows[1])


@query(f"WITH {base_sql('events', 'event_id', FLAGS)} SELECT row_id, valid, CAST(CASE WHEN valid THEN (hits + 10) * 2 ELSE hits END AS BIGINT) AS hits FROM base")
def ir_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = Program((scalar("hits", Op.ADD, 10), scalar("hits", Op.MUL, 2)))
    return shown(Program.deserialise(program.serialise()).run([store_of(spark, sf_dir, "events", "event_id", FLAGS)])[0], "hits")


@query(f"WITH {base_sql('events', 'event_id', FLAGS)} SELECT row_id, valid, CAST(CASE WHEN valid AND lvl BETWEEN 1 AND 1 THEN hits + 10 ELSE hits END AS BIGINT) AS hits FROM base")
def ir_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Program((scalar("hits", Op.ADD, 10),)).run([store_of(spark, sf_dir, "events", "event_id", FLAGS)], (1, 1))[0], "hits")


AGENT: Columns = {"bal": (Kind.FLOAT, "c_acctbal"), "s0": (Kind.FLOAT, "0"), "s1": (Kind.FLOAT, "0"), "variance": (Kind.FLOAT, "(c_custkey % 4) / 8.0"), "able": (Kind.INT32, "c_custkey % 16"), "command": (Kind.INT32, "CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 2 ELSE -1 END"), "choice": (Kind.INT32, "-99")}


@query(
    noise_sql("customer", "c_custkey", AGENT, 5, 11, "")
    + ", x AS (SELECT row_id, valid, variance, able, command, choice, u AS u0, least(greatest((bal + 1000::FLOAT) / 11000::FLOAT, 0::FLOAT), 1::FLOAT)::FLOAT AS x FROM noisy), "
    + "start2 AS (SELECT *, 5::UBIGINT AS z FROM x), "
    + f"{mix_sql('start2', 'n1', 'z')}, {mix_sql('n1', 'n2', 'xor(row_id::UBIGINT, z)')}, {mix_sql('n2', 'n3', 'xor(22::UBIGINT, z)')}, "
    + "s AS (SELECT *, ((1::FLOAT - x)::FLOAT + (variance * u0)::FLOAT)::FLOAT AS s0, ((CASE WHEN (able & 4) = 0 THEN 0::FLOAT ELSE (x * x)::FLOAT END) + (variance * ((z >> 40)::FLOAT / 16777216::FLOAT)::FLOAT)::FLOAT)::FLOAT AS s1 FROM n3) "
    + "SELECT row_id, valid, CAST(CASE WHEN NOT valid THEN choice WHEN command >= 0 THEN command WHEN greatest(s0, s1) >= 0.1::FLOAT THEN CASE WHEN s1 > s0 THEN 1 ELSE 0 END ELSE -1 END AS BIGINT) AS choice FROM s"
)
def utility_ai_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score two abilities by curves, gate one by a bit, perturb both, choose, let commands override."""
    return shown(apply(store_of(spark, sf_dir, "customer", "c_custkey", AGENT), *decision()), "choice")


def decision() -> list[Update]:
    return [
        curved("s0", Op.SET, "bal", Curve(Shape.LINEAR, -1000, 10000, invert=True)),
        curved("s1", Op.SET, "bal", Curve(Shape.POWER, -1000, 10000, 2)),
        scalar("s1", Op.SET, 0).where_typed("able", Cmp.LACKS, 4),
        perturbed("s0", Op.ADD, "variance", Noise(0, 1, 11, 5)),
        perturbed("s1", Op.ADD, "variance", Noise(0, 1, 22, 5)),
        choose("choice", ("s0", "s1"), 0.1, -1),
        column("choice", Op.SET, "command").where("command", Cmp.GE, 0),
    ]


# -- kinds, stores ---------------------------------------------------------------------------

NARROW: Columns = {"b": (Kind.UINT8, "p_size"), "h": (Kind.INT16, "p_size * 100"), "q": (Kind.UINT64, "p_partkey"), "t": (Kind.INT8, "p_size")}
update_query("wrap_uint8_add", "part", "p_partkey", NARROW, [scalar("b", Op.ADD, 230)], {"b": "CASE WHEN valid THEN (b + 230) % 256 ELSE b END"})
update_query("wrap_int8_mul", "part", "p_partkey", NARROW, [scalar("t", Op.MUL, 7)], {"t": "CASE WHEN valid THEN ((t::INT * 7 + 128) % 256 + 256) % 256 - 128 ELSE t END"})
update_query("wrap_int16_mul", "part", "p_partkey", NARROW, [scalar("h", Op.MUL, 9)], {"h": "CASE WHEN valid THEN ((h::INT * 9 + 32768) % 65536 + 65536) % 65536 - 32768 ELSE h END"})
update_query("wide_uint64_mul", "part", "p_partkey", NARROW, [scalar("q", Op.MUL, 5_000_000_000)], {"q": "CASE WHEN valid THEN q::BIGINT * 5000000000 ELSE q::BIGINT END"})


@query("SELECT 'unsigned' AS family, CASE WHEN max(o_orderkey) < 256 THEN 'UINT8' WHEN max(o_orderkey) < 65536 THEN 'UINT16' WHEN max(o_orderkey) < 4294967296 THEN 'UINT32' ELSE 'UINT64' END AS kind FROM orders UNION ALL SELECT 'signed', CASE WHEN min(x) >= -128 AND max(x) < 128 THEN 'INT8' WHEN min(x) >= -32768 AND max(x) < 32768 THEN 'INT16' ELSE 'INT32' END FROM (SELECT trunc(c_acctbal)::INT AS x FROM customer)")
def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).head()[0]
    low, up = read(spark, sf_dir, "customer").agg(F.min(F.col("c_acctbal").cast("int")), F.max(F.col("c_acctbal").cast("int"))).head()
    return spark.createDataFrame([("unsigned", smallest_unsigned(high).name), ("signed", smallest_signed(low, up).name)], "family string, kind string")


@query("SELECT p_partkey AS row_id, p_partkey % 10 <> 3 AS valid, CAST((p_size * 100) % 256 AS BIGINT) AS h, CAST(CASE WHEN p_size - 25 < 0 THEN p_size - 25 + 4294967296 ELSE p_size - 25 END AS BIGINT) AS w, 7::BIGINT AS fresh FROM part")
def convert_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_of(spark, sf_dir, "part", "p_partkey", {"h": (Kind.INT16, "p_size * 100"), "w": (Kind.INT32, "p_size - 25"), "gone": (Kind.DOUBLE, "1")})
    return shown(store.convert([ColumnSpec("h", Kind.UINT8), ColumnSpec("w", Kind.INT64), ColumnSpec("fresh", Kind.INT32, 7)]), "h", "w", "fresh")


@query("SELECT p_partkey AS row_id, trunc(p_retailprice - 1500)::BIGINT AS cut, p_size::DOUBLE AS wide, CASE WHEN p_size - 25 < 0 THEN p_size - 25 + 65536 ELSE p_size - 25 END::BIGINT AS word FROM part")
def convert_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), convert_number(price - 1500, Kind.DOUBLE, Kind.INT32).cast("bigint").alias("cut"), convert_number(size, Kind.INT32, Kind.DOUBLE).alias("wide"), convert_number(size - 25, Kind.INT32, Kind.UINT16).cast("bigint").alias("word")
    )


@query("SELECT count(*) FILTER (o_orderkey % 10 <> 3 AND o_totalprice > 1000) AS affected, count(*) FILTER (o_orderkey % 10 <> 3) AS live FROM orders")
def affected_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_of(spark, sf_dir, "orders", "o_orderkey", PRICE)
    return spark.createDataFrame([(affected(store, scalar("price", Op.ADD, 1).where("price", Cmp.GT, 1000)), store.live_count())], "affected long, live long")


@query("SELECT o_orderkey % 3 AS lvl, count(*) FILTER (o_orderkey % 10 <> 3) AS live, count(*) AS capacity FROM orders GROUP BY 1")
def live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = store_of(spark, sf_dir, "orders", "o_orderkey", PRICE).frame
    return frame.groupBy(F.col("_level").cast("bigint").alias("lvl")).agg(F.sum(F.col("_valid").cast("long")).alias("live"), F.count(F.lit(1)).alias("capacity"))


@query(f"WITH {base_sql('part', 'p_partkey', SCORE)} SELECT round(size, 4) AS size, round(price, 4) AS price FROM base")
def store_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_of(spark, sf_dir, "part", "p_partkey", SCORE).dump().select(F.round("size", 4).alias("size"), F.round("price", 4).alias("price"))


@query("SELECT s_suppkey AS row_id, s_suppkey % 10 <> 3 AND s_suppkey % 7 <> 2 AS valid, s_suppkey % 4 = 1 AND s_suppkey % 7 <> 2 AS locked, CASE WHEN s_acctbal > 5000 THEN 9 ELSE s_suppkey % 3 END::BIGINT AS lvl FROM supplier")
def row_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_of(spark, sf_dir, "supplier", "s_suppkey", {"bal": (Kind.DOUBLE, "s_acctbal")})
    store = store.set_locked(F.col("_row") % 4 == 1).set_level(F.col("bal") > 5000, 9).free(F.col("_row") % 7 == 2)
    return store.frame.select(F.col("_row").alias("row_id"), F.col("_valid").alias("valid"), F.col("_locked").alias("locked"), F.col("_level").cast("bigint").alias("lvl"))


# -- snapshots and views ---------------------------------------------------------------------


@query(f"WITH {base_sql('events', 'event_id', FLAGS)} SELECT row_id, hits::BIGINT AS hits, flags::BIGINT AS flags FROM base WHERE valid")
def dataview_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot(store_of(spark, sf_dir, "events", "event_id", FLAGS), ["hits", "flags", "absent"])
    return rows.select(F.col("_row").alias("row_id"), F.col("hits").cast("bigint"), F.col("flags").cast("bigint"))


@query(f"WITH {base_sql('events', 'event_id', FLAGS)} SELECT row_id, hits::BIGINT AS hits FROM base WHERE valid AND lvl BETWEEN 1 AND 2")
def dataview_lod_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot(store_of(spark, sf_dir, "events", "event_id", FLAGS), ["hits"], (1, 2))
    return rows.select(F.col("_row").alias("row_id"), F.col("hits").cast("bigint"))


ORDERS: Columns = {"price": (Kind.DOUBLE, "o_totalprice"), "cust": (Kind.INT32, "CASE WHEN o_custkey % 7 = 0 THEN 2147483647 ELSE o_custkey END")}
CUSTOMER: Columns = {"bal": (Kind.DOUBLE, "c_acctbal"), "nation": (Kind.INT32, "c_nationkey")}


def shop(spark: SparkSession, sf_dir: str) -> dict[str, Store]:
    return {"orders": store_of(spark, sf_dir, "orders", "o_orderkey", ORDERS), "customer": store_of(spark, sf_dir, "customer", "c_custkey", CUSTOMER)}


_SHOP = f"WITH o AS ({base_sql('orders', 'o_orderkey', ORDERS)[9:-1]}), c AS ({base_sql('customer', 'c_custkey', CUSTOMER)[9:-1]}), j AS (SELECT o.row_id, o.price, o.cust, c.row_id AS c_row, coalesce(c.bal, 0) AS bal FROM o LEFT JOIN c ON o.cust = c.row_id AND o.cust <> 2147483647 AND c.valid WHERE o.valid)"
LINK = (Join("customer", "cust"),)
BOTH = (Pick(0, "price"), Pick(1, "bal"))


def view_rows(v: View) -> DataFrame:
    return v.rows.select(F.col("_base_row").alias("row_id"), F.col("_join1_row").alias("join_row"), F.round("price", 4).alias("price"), F.round("bal", 4).alias("bal"))


def view_query(name: str, scope: tuple, program: tuple, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view_rows(View("orders", BOTH, LINK, scope, program).refresh(shop(spark, sf_dir)))

    QUERIES[name] = run
    ORACLES[name] = f"{_SHOP} SELECT row_id, c_row AS join_row, round(price, 4) AS price, round(bal, 4) AS bal FROM j WHERE {where}"


view_query("view_join_deref", (), (), "TRUE")
view_query("view_scope", (Scope("price", Cmp.GT, 200000), Scope("cust", Cmp.LT, 700)), (), "price > 200000 AND cust < 700")
view_query("view_rpn_or", (), (Leaf(0, "price", Cmp.GE, 300000), Leaf(1, "bal", Cmp.LT, 0), OR), "price >= 300000 OR (c_row IS NOT NULL AND bal < 0)")
view_query("view_rpn_not_absent", (), (Leaf(1, "bal", Cmp.GT, 5000), NOT), "NOT (c_row IS NOT NULL AND bal > 5000)")
view_query("view_rpn_nested", (), (Leaf(0, "price", Cmp.LT, 100000), Leaf(1, "bal", Cmp.GT, 0), AND, Leaf(0, "cust", RANGE, 100, 200), OR, NOT, OR), "NOT ((price < 100000 AND c_row IS NOT NULL AND bal > 0) OR cust BETWEEN 100 AND 200)")
view_query("view_range", (), (Leaf(0, "price", RANGE, 100000, 200000),), "price BETWEEN 100000 AND 200000")
view_query("view_range_wrapped", (), (Leaf(0, "cust", RANGE, 900, 400),), "NOT (cust > 400 AND cust < 900)")


@query("SELECT s_suppkey AS row_id, round(s_acctbal, 4) AS bal, CASE WHEN p.p_partkey IS NULL THEN NULL ELSE p.p_partkey END AS join_row, coalesce(p.p_size, 0)::BIGINT AS size FROM supplier LEFT JOIN part p ON s_suppkey = p.p_partkey AND p.p_partkey % 10 <> 3 AND p.p_partkey % 4 <> 1 WHERE s_suppkey % 10 <> 3")
def view_join_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = store_of(spark, sf_dir, "part", "p_partkey", {"size": (Kind.INT32, "p_size")})
    stores = {"supplier": store_of(spark, sf_dir, "supplier", "s_suppkey", {"bal": (Kind.DOUBLE, "s_acctbal")}), "part": part.free(F.col("_row") % 4 == 1)}
    v = View("supplier", (Pick(0, "bal"), Pick(1, "size")), (Join("part"),)).refresh(stores)
    return v.rows.select(F.col("_base_row").alias("row_id"), F.round("bal", 4).alias("bal"), F.col("_join1_row").alias("join_row"), F.col("size").cast("bigint"))


@query(
    f"WITH o AS ({base_sql('orders', 'o_orderkey', ORDERS)[9:-1]}), c AS ({base_sql('customer', 'c_custkey', CUSTOMER)[9:-1]}) "
    "SELECT o.row_id, c.row_id AS c_row, a.row_id AS a_row, round(coalesce(c.bal, 0), 4) AS bal, round(coalesce(a.bal, 0), 4) AS aligned_bal FROM o "
    "LEFT JOIN c ON o.cust = c.row_id AND o.cust <> 2147483647 AND c.valid LEFT JOIN c a ON o.row_id = a.row_id AND a.valid WHERE o.valid"
)
def view_join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View("orders", (Pick(1, "bal"), Pick(2, "bal", "aligned_bal")), (Join("customer", "cust"), Join("customer"))).refresh(shop(spark, sf_dir))
    return v.rows.select(F.col("_base_row").alias("row_id"), F.col("_join1_row").alias("c_row"), F.col("_join2_row").alias("a_row"), F.round("bal", 4).alias("bal"), F.round("aligned_bal", 4).alias("aligned_bal"))


# -- write-back ------------------------------------------------------------------------------


@query(f"{_SHOP}, last AS (SELECT c_row, arg_max(price * 2, row_id) AS v FROM j WHERE price > 150000 AND c_row IS NOT NULL GROUP BY 1) SELECT c.row_id, c.valid, round(coalesce(last.v, c.bal), 9) AS bal FROM c LEFT JOIN last ON c.row_id = last.c_row")
def commit_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = shop(spark, sf_dir)
    v = View("orders", BOTH, LINK, update=(Write("price", "customer", "bal"),)).refresh(stores)
    v = v.change(F.col("price") > 150000, {"price": F.col("price") * 2})
    return shown(v.commit(stores)[0]["customer"], "bal")


NATION: Columns = {"region": (Kind.INT32, "n_regionkey"), "code": (Kind.INT32, "n_nationkey * 10")}
REGION: Columns = {"power": (Kind.INT32, "r_regionkey * 5")}


def world(spark: SparkSession, sf_dir: str) -> dict[str, Store]:
    return {"nation": store_of(spark, sf_dir, "nation", "n_nationkey", NATION), "region": store_of(spark, sf_dir, "region", "r_regionkey", REGION).grown(6)}


_WORLD = """WITH fresh AS (SELECT r_regionkey AS k, r_regionkey + 100 AS code, r_regionkey + 50 AS power FROM region),
nslot AS (SELECT n_nationkey AS slot, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation WHERE n_nationkey % 10 = 3),
rall AS (SELECT r_regionkey AS row_id, r_regionkey % 10 <> 3 AS valid, r_regionkey * 5 AS power FROM region UNION ALL SELECT 5 + i, FALSE, 0 FROM range(6) t(i)),
rslot AS (SELECT row_id AS slot, row_number() OVER (ORDER BY row_id) - 1 AS k FROM rall WHERE NOT valid)"""


def fresh_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") + 100).alias("code"), (F.col("r_regionkey") + 50).alias("power"))


@query(f"{_WORLD} SELECT n_nationkey AS row_id, n_nationkey % 10 <> 3 OR f.k IS NOT NULL AS valid, coalesce(f.code, n_nationkey * 10)::BIGINT AS code, (CASE WHEN f.k IS NOT NULL THEN 0 ELSE n_regionkey END)::BIGINT AS region FROM nation LEFT JOIN nslot ON slot = n_nationkey LEFT JOIN fresh f ON f.k = nslot.k")
def commit_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = world(spark, sf_dir)
    v = View("nation", (Pick(0, "code"),), insert=(Write("code", "nation", "code"),)).refresh(stores)
    return shown(v.add_rows(fresh_rows(spark, sf_dir), "k").commit(stores)[0]["nation"], "code", "region")


@query(
    f"{_WORLD}, nout AS (SELECT 'nation' AS store, n_nationkey AS row_id, n_nationkey % 10 <> 3 OR f.k IS NOT NULL AS valid, coalesce(f.code, n_nationkey * 10)::BIGINT AS v, (CASE WHEN f.k IS NULL THEN n_regionkey ELSE coalesce(rslot.slot, 0) END)::BIGINT AS link FROM nation LEFT JOIN nslot ON slot = n_nationkey LEFT JOIN fresh f ON f.k = nslot.k LEFT JOIN rslot ON rslot.k = f.k) "
    "SELECT * FROM nout UNION ALL SELECT 'region', row_id, valid OR f.k IS NOT NULL, coalesce(f.power, rall.power)::BIGINT, -1 FROM rall LEFT JOIN rslot ON slot = row_id LEFT JOIN fresh f ON f.k = rslot.k"
)
def commit_linked_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = world(spark, sf_dir)
    v = View("nation", (Pick(0, "code"), Pick(1, "power")), (Join("region", "region"),), insert=(Write("code", "nation", "code"), Write("power", "region", "power"))).refresh(stores)
    out, _ = v.add_rows(fresh_rows(spark, sf_dir), "k").commit(stores)
    pick = lambda s, c, link: out[s].frame.select(F.lit(s).alias("store"), F.col("_row").alias("row_id"), F.col("_valid").alias("valid"), F.col(c).cast("bigint").alias("v"), link.cast("bigint").alias("link"))
    return pick("nation", "code", F.col("region")).unionByName(pick("region", "power", F.lit(-1)))


@query(f"{_SHOP}, gone AS (SELECT DISTINCT c_row FROM j WHERE price > 350000 AND c_row IS NOT NULL) SELECT c.row_id, c.valid AND gone.c_row IS NULL AS valid, round(c.bal, 9) AS bal FROM c LEFT JOIN gone ON c.row_id = gone.c_row")
def commit_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = shop(spark, sf_dir)
    v = View("orders", BOTH, LINK, delete=("customer",)).refresh(stores).remove(F.col("price") > 350000)
    return shown(v.commit(stores)[0]["customer"], "bal")


@query("WITH dead AS (SELECT c_custkey AS slot, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer WHERE c_custkey % 10 = 3 OR c_custkey % 17 = 5), fresh AS (SELECT s_suppkey AS k, s_acctbal + 1 AS bal FROM supplier) SELECT c_custkey AS row_id, (c_custkey % 10 <> 3 AND c_custkey % 17 <> 5) OR f.k IS NOT NULL AS valid, round(coalesce(f.bal, c_acctbal), 9) AS bal FROM customer LEFT JOIN dead ON slot = c_custkey LEFT JOIN fresh f ON f.k = dead.k")
def alloc_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = {"customer": store_of(spark, sf_dir, "customer", "c_custkey", BAL).free(F.col("_row") % 17 == 5)}
    v = View("customer", (Pick(0, "bal"),), insert=(Write("bal", "customer", "bal"),)).refresh(stores)
    new = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") + 1).alias("bal"))
    return shown(v.add_rows(new, "k").commit(stores)[0]["customer"], "bal")


# -- ticks -----------------------------------------------------------------------------------

COUNT: Columns = {"c0": (Kind.INT32, "0"), "c1": (Kind.INT32, "0"), "c2": (Kind.INT32, "0")}
_SUP = base_sql("supplier", "s_suppkey", COUNT)


def ticking(spark: SparkSession, sf_dir: str) -> Scheduler:
    return Scheduler({0: store_of(spark, sf_dir, "supplier", "s_suppkey", COUNT)}, cut_every=0)


def bump(name: str) -> Program:
    return Program((scalar(name, Op.ADD, 1),))


@query(f"WITH {_SUP} SELECT row_id, valid, CASE WHEN valid THEN 8 ELSE 0 END::BIGINT AS c0, CASE WHEN valid THEN 2 ELSE 0 END::BIGINT AS c1, CASE WHEN valid THEN 8 ELSE 0 END::BIGINT AS c2 FROM base")
def tick_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ticking(spark, sf_dir)
    s.add_program(bump("c0"))
    s.add_program(bump("c1"), period=4)
    s.add_program(bump("c2"), period=0)
    return shown(s.run(8).stores[0], "c0", "c1", "c2")


@query(f"WITH {_SUP}, t AS (SELECT count(*) FILTER (i % 4 = 0) AS a, count(*) FILTER (i % 4 = 1) AS b, count(*) FILTER (i % 3 = 2) AS c FROM range(1, 8) r(i)) SELECT row_id, valid, CASE WHEN valid THEN a ELSE 0 END::BIGINT AS c0, CASE WHEN valid THEN b ELSE 0 END::BIGINT AS c1, CASE WHEN valid THEN c ELSE 0 END::BIGINT AS c2 FROM base, t")
def tick_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ticking(spark, sf_dir)
    s.add_program(bump("c0"), period=4)
    s.add_program(bump("c1"), period=4, phase=5)
    s.add_program(bump("c2"), period=3, phase=2)
    return shown(s.run(7).stores[0], "c0", "c1", "c2")


@query(f"WITH {_SUP} SELECT row_id, valid, CASE WHEN NOT valid THEN 0 WHEN lvl = 0 THEN 4 WHEN lvl = 2 THEN 1 ELSE 0 END::BIGINT AS c0 FROM base")
def tick_lod_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ticking(spark, sf_dir)
    s.add_program(bump("c0"), band=(0, 0))
    s.add_program(bump("c0"), period=4, band=(2, 2))
    return shown(s.run(4).stores[0], "c0")


@query(f"WITH {_SUP} SELECT row_id, 3::BIGINT AS c0 FROM base WHERE valid")
def tick_view_after_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ticking(spark, sf_dir)
    s.add_program(bump("c0"))
    s.add_snapshot("seen", 0, ["c0"], period=3)
    s.run(4)
    return s.snapshots["seen"].select(F.col("_row").alias("row_id"), F.col("c0").cast("bigint"))


@query(f"WITH {_SUP} SELECT row_id, valid, CASE WHEN NOT valid THEN 0 WHEN row_id % 2 = 0 THEN 51 ELSE 2 END::BIGINT AS c0 FROM base")
def tick_rwview(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ticking(spark, sf_dir)
    s.add_program(bump("c0"))
    s.add_view("edit", View(0, (Pick(0, "c0"),), update=(Write("c0", 0, "c0"),)))
    s.tick()
    s.views["edit"] = s.views["edit"].change(F.col("_base_row") % 2 == 0, {"c0": F.lit(50)})
    s.tick()
    return shown(s.stores[0], "c0")


# -- declarative queries ---------------------------------------------------------------------


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "part", "supplier")}


_REVENUE = Binary("mul", Ref("l_extendedprice"), Binary("sub", Const(1.0), Ref("l_discount")))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(l_orderkey) AS n, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2")
def q_group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query("lineitem", group=("l_returnflag", "l_linestatus"), aggregates=(Aggregate("sum", Ref("l_quantity"), "qty"), Aggregate("count", Ref("l_orderkey"), "n"), Aggregate("min", Ref("l_extendedprice"), "low"), Aggregate("max", Ref("l_extendedprice"), "high"), Aggregate("avg", Ref("l_discount"), "disc")))
    return q.build(tables(spark, sf_dir)).select("l_returnflag", "l_linestatus", F.round("qty", 2).alias("qty"), "n", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round("disc", 6).alias("disc"))


@query("SELECT l_returnflag, round(sum(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END), 2) AS big FROM lineitem GROUP BY 1")
def q_sumif(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query("lineitem", group=("l_returnflag",), aggregates=(Aggregate("sumif", Ref("l_extendedprice"), "big", Binary("gt", Ref("l_quantity"), Const(25.0))),))
    return q.build(tables(spark, sf_dir)).select("l_returnflag", F.round("big", 2).alias("big"))


@query("SELECT n_name, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= 100000 GROUP BY 1")
def q_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query("orders", joins=(EquiJoin("customer", "o_custkey", "c_custkey"), EquiJoin("nation", "c_nationkey", "n_nationkey")), where=(Test("ge", "o_totalprice", 100000),), group=("n_name",), aggregates=(Aggregate("count", Ref("o_orderkey"), "n"), Aggregate("sum", Ref("o_totalprice"), "total")))
    return q.build(tables(spark, sf_dir)).select("n_name", "n", F.round("total", 2).alias("total"))


@query("SELECT o_orderkey, round(-(o_totalprice / 7 + 1), 4) AS a, o_orderkey % 5 AS b, CAST(trunc(o_custkey / 10) AS BIGINT) AS c, (o_orderkey & 6) AS d, (o_orderkey & 2) = 2 AND NOT (o_orderkey & 4) = 0 AS e FROM orders")
def q_calc_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = Ref("o_orderkey")
    q = Query("orders", ("o_orderkey", "a", "b", "c", "d", "e"), calculated=(
        ("a", Unary("neg", Binary("add", Binary("div", Ref("o_totalprice"), Const(7)), Const(1)))), ("b", Binary("mod", key, Const(5))), ("c", Binary("div", Ref("o_custkey"), Const(10), "bigint")),
        ("d", Binary("bitand", key, Const(6), "bigint")), ("e", Binary("and", Binary("has", key, Const(2)), Unary("not", Binary("lacks", key, Const(4))))),
    ))
    return q.build(tables(spark, sf_dir)).withColumn("a", F.round("a", 4))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_custkey % 10 DESC, o_orderkey LIMIT 50 OFFSET 20")
def q_sort_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query("orders", ("o_orderkey", "o_totalprice"), sort=(Sort(Binary("mod", Ref("o_custkey"), Const(10)), False), Sort("o_orderkey")), limit=50, offset=20)
    return q.build(tables(spark, sf_dir)).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT c_custkey FROM customer WHERE ((c_acctbal BETWEEN 100 AND 5000) <> (c_nationkey < 10)) AND NOT (c_mktsegment = 'BUILDING' OR c_custkey % 2 <> 0 AND c_nationkey = c_custkey)")
def q_nested_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = Test("ne", "odd", 0)
    no = Test("not", parts=(Test("or", parts=(Test("eq", "c_mktsegment", "BUILDING"), Test("and", parts=(odd, Test("eq", "c_nationkey", other="c_custkey"))))),))
    frames = {"customer": read(spark, sf_dir, "customer").withColumn("odd", F.col("c_custkey") % 2)}
    return Query("customer", ("c_custkey",), where=(Test("xor", parts=(Test("range", "c_acctbal", 100, high=5000), Test("lt", "c_nationkey", 10))), no)).build(frames)


@query("SELECT * FROM supplier WHERE (s_suppkey & 3) = 3 AND (s_suppkey & 4) = 0")
def q_select_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query("supplier", select_all=True, where=(Test("has", "s_suppkey", 3), Test("lacks", "s_suppkey", 4))).build(tables(spark, sf_dir))


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)) / count(l_orderkey), 4) AS mean FROM lineitem GROUP BY 1")
def q_group_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query("lineitem", ("l_returnflag", "mean"), calculated=(("rev", _REVENUE),), group=("l_returnflag",), aggregates=(Aggregate("sum", Ref("rev"), "s"), Aggregate("count", Ref("l_orderkey"), "n")), group_calculated=(("mean", Binary("div", Ref("s"), Ref("n"))),))
    return q.build(tables(spark, sf_dir)).select("l_returnflag", F.round("mean", 4).alias("mean"))


@query("WITH s AS (SELECT o_custkey * 2 AS k, max(o_totalprice) AS top FROM orders GROUP BY 1), t AS (SELECT c_custkey AS k, c_acctbal AS bal FROM customer) SELECT coalesce(t.k, s.k) AS k, round(CASE WHEN t.k IS NULL THEN 0 WHEN s.k IS NULL THEN t.bal ELSE t.bal + s.top END, 2) AS bal FROM t FULL JOIN s ON t.k = s.k")
def u_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    source = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).alias("k")).agg(F.max("o_totalprice").alias("top")).withColumn("bal", F.lit(0.0))
    return Upsert("k", (("bal", Binary("add", Ref("bal"), Ref("new_top"))),)).build(target, source).withColumn("bal", F.round("bal", 2))


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 380000) AND NOT (c_acctbal < -500)")
def u_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    source = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top"))
    out = Upsert("k", insert_if_not_exists=False, delete_if_removed=True, removed=Test("gt", "top", 380000)).build(target, source)
    return Delete((Test("lt", "c_acctbal", -500),)).build(out).select("k")


@query("WITH pick AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 5) SELECT c_custkey AS k, round(CASE WHEN c_custkey IN (SELECT c_custkey FROM pick) THEN c_acctbal * 2 ELSE c_acctbal END, 2) AS bal FROM customer")
def u_set_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    u = Assign((("bal", Binary("mul", Ref("bal"), Const(2.0))),), (Test("gt", "bal", 0),), (Sort("bal", False), Sort("k")), 30, 5, "k")
    return u.build(target).withColumn("bal", F.round("bal", 2))


# -- loading, cells, flags and shape of stores -----------------------------------------------

NATION_BYTES = (ColumnSpec("region", Kind.INT32), ColumnSpec("code", Kind.INT16), ColumnSpec("share", Kind.DOUBLE), ColumnSpec("id", Kind.UINT64))


def nation_bytes(spark: SparkSession, sf_dir: str) -> bytes:
    """The 25 nations as row-major bytes."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return b"".join(struct.pack("<ihdQ", r.n_regionkey - 2, r.n_nationkey * 10, r.n_nationkey / 4, r.n_nationkey + (1 << 63)) for r in rows)


@query("SELECT n_nationkey AS row_id, FALSE AS valid, n_regionkey::BIGINT - 2 AS region, n_nationkey::BIGINT * 10 AS code, round(n_nationkey / 4, 9) AS share, (n_nationkey::HUGEINT + 9223372036854775808)::VARCHAR AS id FROM nation")
def store_load_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made from whole rows, then replaced by bytes whose last row is partial."""
    data = nation_bytes(spark, sf_dir)
    store = Store.from_bytes(spark, NATION_BYTES, data[: 3 * 22]).load_bytes(data + b"\1\2\3")
    return store.frame.select(F.col("_row").alias("row_id"), F.col("_valid").alias("valid"), F.col("region").cast("bigint"), F.col("code").cast("bigint"), F.round("share", 9).alias("share"), F.col("id").cast("string").alias("id"))


@query("SELECT o_orderkey AS row_id, (o_custkey % 200 - 100)::BIGINT AS a, round(o_totalprice, 9) AS b FROM orders")
def store_bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to bytes and back, on the executors."""
    store = store_of(spark, sf_dir, "orders", "o_orderkey", {"a": (Kind.INT8, "o_custkey % 200 - 100"), "b": (Kind.DOUBLE, "o_totalprice")})
    back = store.load_frame(store.dump_bytes(), "_row", "data")
    return back.frame.select(F.col("_row").alias("row_id"), F.col("a").cast("bigint"), F.round("b", 9).alias("b"))


@query("SELECT r_regionkey::BIGINT AS row_id, FALSE AS valid, r_regionkey::BIGINT * 5 AS power FROM region UNION ALL SELECT 5 + i, FALSE, 0 FROM range(4) t(i)")
def store_extra_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.r_regionkey * 5,) for r in read(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return shown(Store.from_rows(spark, [ColumnSpec("power", Kind.INT32)], rows, extra=4), "power")


@query("SELECT n_nationkey AS row_id, n_nationkey % 10 <> 3 AS valid, CASE n_nationkey WHEN 4 THEN 70000 % 65536 WHEN 5 THEN -7 WHEN 6 THEN 66 ELSE n_nationkey * 10 END::BIGINT AS code, CASE WHEN n_nationkey = 8 THEN (SELECT n_regionkey FROM nation WHERE n_nationkey = 13) ELSE n_regionkey END::BIGINT AS region FROM nation UNION ALL SELECT -1, FALSE, 0, 1")
def store_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell reads and writes: wrapped to the width, checked ones, a bulk of them, of dead rows too."""
    store = store_of(spark, sf_dir, "nation", "n_nationkey", {"code": (Kind.INT16, "n_nationkey * 10"), "region": (Kind.INT32, "n_regionkey")})
    store = store.set(4, "code", 70000).set(99, "code", 1).set(4, "none", 1)
    refused, store = store.try_set(99, "code", 1)
    taken, store = store.try_set(5, "code", -7)
    store = store.write_cells("code", spark.createDataFrame([(6, 66), (77, 1)], "row long, value int"))
    store = store.set(8, "region", store.get(13, "region"))
    tell = spark.createDataFrame([(-1, refused, 0 if store.get(99, "code") is None else 1, int(taken))], "row_id long, valid boolean, code long, region long")
    return shown(store, "code", "region").unionByName(tell)


@query("SELECT * FROM (VALUES ('rows', 25), ('columns', 4), ('row_stride', 22), ('stride_region', 4), ('stride_code', 2), ('stride_share', 8), ('stride_id', 8), ('stride_none', 0), ('schema_strides', 22)) t(name, n)")
def store_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.from_bytes(spark, NATION_BYTES, nation_bytes(spark, sf_dir))
    rows = [("rows", store.row_count), ("columns", store.column_count), ("row_stride", store.row_stride), *[(f"stride_{c}", store.column_stride(c)) for c in ("region", "code", "share", "id", "none")], ("schema_strides", sum(f.metadata["stride"] for f in store.schema))]
    return spark.createDataFrame(rows, "name string, n int")


@query("SELECT s_suppkey AS row_id, CASE WHEN s_suppkey = 3 THEN TRUE WHEN s_suppkey % 4 = 1 THEN FALSE ELSE s_suppkey % 10 <> 3 END AS valid, round(s_acctbal, 9) AS bal, (SELECT count(*) FILTER (s_suppkey = 3 OR s_suppkey % 4 <> 1 AND s_suppkey % 10 <> 3) FROM supplier) AS live FROM supplier")
def row_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_of(spark, sf_dir, "supplier", "s_suppkey", {"bal": (Kind.DOUBLE, "s_acctbal")}).set_valid(F.col("_row") % 4 == 1, False).set_valid(3).set_valid(10**9)
    return shown(store, "bal").withColumn("live", F.lit(store.live_count()))


@query("WITH dead AS (SELECT n_nationkey AS s, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_nationkey % 10 = 3 OR n_nationkey = 7) SELECT n_nationkey AS row_id, n_nationkey % 10 <> 3 AND n_nationkey <> 7 OR coalesce(k <= 2, FALSE) AS valid, CASE WHEN k <= 2 THEN 77 ELSE n_nationkey * 10 END::BIGINT AS code FROM nation LEFT JOIN dead ON s = n_nationkey")
def store_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest two free rows, with their default."""
    store = store_of(spark, sf_dir, "nation", "n_nationkey", {"code": (Kind.INT32, "n_nationkey * 10")})
    store = Store(store.frame, (ColumnSpec("code", Kind.INT32, 77),), store.capacity).free(7)
    return shown(store.allocate(2)[1], "code")


@query("SELECT 'store nation version 1 written' AS said, 1::BIGINT AS n")
def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a callback gets to read when a store is written."""
    said: list[str] = []
    log_to(lambda level, text: said.append(text.split(" to ")[0]))
    try:
        pinned = store_of(spark, sf_dir, "nation", "n_nationkey", {"code": (Kind.INT32, "n_nationkey")}).pinned()
    finally:
        log_to(None)
    delete_tables(spark, pinned.pins)
    return spark.createDataFrame([(t,) for t in said], "said string").groupBy("said").agg(F.count(F.lit(1)).alias("n"))


_BITS: Columns = {"a": (Kind.FLOAT, "1 << (p_size % 8)"), "b": (Kind.INT32, "(127 + p_size % 8) * 8388608"), "c": (Kind.DOUBLE, "1 << (p_size % 8)")}


@query("SELECT p_partkey AS row_id, p_partkey % 10 <> 3 AS valid, (127 + p_size % 8)::BIGINT * 8388608 AS a, (1 << (p_size % 8))::DOUBLE AS b, 0::BIGINT AS c FROM part")
def convert_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of floating cells read as whole ones and back: sign, exponent and fraction of powers of two."""
    store = store_of(spark, sf_dir, "part", "p_partkey", _BITS).convert([ColumnSpec("a", Kind.INT32), ColumnSpec("b", Kind.FLOAT), ColumnSpec("c", Kind.UINT32)])
    return shown(store, "a", "b", "c")


# -- more of views and write-back ------------------------------------------------------------


@query(f"{_SHOP} SELECT row_id, c_row AS join_row, round(price, 4) AS price, round(bal, 4) AS bal FROM j WHERE price > 100000 ORDER BY row_id LIMIT 40")
def view_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty rows in view order."""
    v = View("orders", BOTH, LINK, (Scope("price", Cmp.GT, 100000),)).refresh(shop(spark, sf_dir))
    first = replace(v, rows=v.data().limit(40))
    return view_rows(first)


NARROW: Columns = {"i8": (Kind.INT8, "o_custkey % 256 - 128"), "i16": (Kind.INT16, "o_custkey - 600")}


@query(
    f"WITH o AS ({base_sql('orders', 'o_orderkey', NARROW)[9:-1]}), c AS ({base_sql('customer', 'c_custkey', CUSTOMER)[9:-1]}), z AS (SELECT row_id, CASE WHEN i8 < 0 THEN i8 + 256 ELSE i8 END AS a, CASE WHEN i16 < 0 THEN i16 + 65536 ELSE i16 END AS b FROM o WHERE valid) "
    "SELECT z.row_id, x.row_id AS a_row, round(coalesce(x.bal, 0), 4) AS a_bal, y.row_id AS b_row FROM z LEFT JOIN c x ON x.row_id = a AND a <> 255 AND x.valid LEFT JOIN c y ON y.row_id = b AND y.valid"
)
def view_join_narrow_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative INT8 and INT16 indices are rows of the upper half; 255 is the first join's absent value.

    Keys beyond INT16 keep their low bytes, as cells do; the SQL's CAST raises there.
    """
    wide = store_of(spark, sf_dir, "orders", "o_orderkey", {n: (Kind.INT64, e) for n, (_, e) in NARROW.items()})
    stores = {"orders": wide.convert([ColumnSpec(n, kind) for n, (kind, _) in NARROW.items()]), "customer": shop(spark, sf_dir)["customer"]}
    v = View("orders", (Pick(1, "bal", "a_bal"), Pick(2, "bal", "b_bal")), (Join("customer", "i8", 255), Join("customer", "i16"))).refresh(stores)
    return v.rows.select(F.col("_base_row").alias("row_id"), F.col("_join1_row").alias("a_row"), F.round("a_bal", 4).alias("a_bal"), F.col("_join2_row").alias("b_row"))


@query(
    f"{_SHOP}, gone AS (SELECT DISTINCT c_row FROM j WHERE price < 20000 AND c_row IS NOT NULL), last AS (SELECT c_row, arg_max(price * 2, row_id) AS v FROM j WHERE price > 150000 AND c_row IS NOT NULL GROUP BY 1), "
    "dead AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS k FROM c WHERE NOT valid OR row_id IN (SELECT c_row FROM gone)) "
    "SELECT c.row_id, c.valid AND gone.c_row IS NULL OR r_regionkey IS NOT NULL AS valid, round(coalesce(r_regionkey * 11.5, last.v, c.bal), 9) AS bal FROM c LEFT JOIN gone ON gone.c_row = c.row_id LEFT JOIN last ON last.c_row = c.row_id LEFT JOIN dead ON dead.row_id = c.row_id LEFT JOIN region ON r_regionkey = dead.k"
)
def commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates and deletes of shared targets, then new rows in the lowest slots, freed ones among them."""
    stores = shop(spark, sf_dir)
    write = (Write("price", "customer", "bal"),)
    v = View("orders", BOTH, LINK, update=write, insert=write, delete=("customer",)).refresh(stores)
    v = v.change(F.col("price") > 150000, {"price": F.col("price") * 2}).remove(F.col("price") < 20000)
    new = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") * 11.5).alias("price"))
    return shown(v.add_rows(new, "k").commit(stores)[0]["customer"], "bal")


@query(f"{_WORLD} SELECT rslot.slot AS join_row, nslot.slot AS base_row, f.code::BIGINT AS code, 2 AS state FROM fresh f LEFT JOIN nslot USING (k) LEFT JOIN rslot USING (k) UNION ALL SELECT r.row_id, n_nationkey, n_nationkey * 10, 0 FROM nation LEFT JOIN rall r ON r.row_id = n_regionkey AND r.valid WHERE n_nationkey % 10 <> 3")
def commit_source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view after an insert: its new rows name the rows they got."""
    stores = world(spark, sf_dir)
    v = View("nation", (Pick(0, "code"), Pick(1, "power")), (Join("region", "region"),), insert=(Write("code", "nation", "code"), Write("power", "region", "power"))).refresh(stores)
    _, after = v.add_rows(fresh_rows(spark, sf_dir), "k").commit(stores)
    return after.rows.select(F.col("_join1_row").alias("join_row"), F.col("_base_row").alias("base_row"), F.col("code").cast("bigint"), F.col("_state").alias("state"))


@query(f"{_SHOP}, last AS (SELECT c_row, arg_max(price, row_id) AS v FROM j WHERE price > 200000 AND c_row IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS ops FROM j WHERE price > 200000 AND c_row IS NOT NULL) SELECT c.row_id, c.valid, round(coalesce(last.v, c.bal), 9) AS bal, ops FROM c LEFT JOIN last ON c.row_id = last.c_row, n")
def view_first_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two joins with one store: a write goes to the row of the first; with the commit's count of writes."""
    stores = shop(spark, sf_dir)
    v = View("orders", BOTH, (Join("customer", "cust"), Join("customer")), update=(Write("price", "customer", "bal"),)).refresh(stores)
    out, _, done = v.change(F.col("price") > 200000).commit_counted(stores)
    return shown(out["customer"], "bal").withColumn("ops", F.lit(done).cast("bigint"))


@query("WITH dead AS (SELECT s_suppkey AS s, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier WHERE s_suppkey % 10 = 3) SELECT s_suppkey AS row_id, s_suppkey % 10 <> 3 OR k <= 2 AS valid, round(CASE WHEN k = 1 THEN 5.5 WHEN k = 2 THEN 0 WHEN s_suppkey = 4 THEN 2.25 WHEN s_suppkey = 6 THEN -1 ELSE s_acctbal END, 9) AS bal, CASE WHEN k = 1 THEN 8 WHEN k = 2 THEN 9 ELSE s_nationkey END::BIGINT AS nation FROM supplier LEFT JOIN dead ON s = s_suppkey WHERE (SELECT count(*) FROM dead) > 1 UNION ALL SELECT s_suppkey, s_suppkey % 10 <> 3 OR k = 1, round(CASE WHEN k = 1 THEN 5.5 WHEN s_suppkey = 4 THEN 2.25 WHEN s_suppkey = 6 THEN -1 ELSE s_acctbal END, 9), CASE WHEN k = 1 THEN 8 ELSE s_nationkey END::BIGINT FROM supplier LEFT JOIN dead ON s = s_suppkey WHERE (SELECT count(*) FROM dead) = 1")
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell commands: the last of two counts, new records fill free rows, unknown names are skipped."""
    store = store_of(spark, sf_dir, "supplier", "s_suppkey", {"bal": (Kind.DOUBLE, "s_acctbal"), "nation": (Kind.INT32, "s_nationkey")})
    orders = [Command("s", "bal", 4, 1.0), Command("s", "bal", 4, 2.25), Command("s", "bal", 6, -1.0), Command("s", "bal", "x", 5.5), Command("s", "nation", "x", 8), Command("s", "nation", "y", 9), Command("t", "bal", 1, 0.0), Command("s", "none", 1, 0.0)]
    return shown(run_commands({"s": store}, orders)[0]["s"], "bal", "nation")


# -- more of updates, ticks and declarative objects ------------------------------------------

_ODD: Columns = {"size": (Kind.INT32, "p_size"), "wide": (Kind.INT64, "p_size * 3")}


@query(f"WITH {base_sql('part', 'p_partkey', _ODD)} SELECT row_id, valid, (CASE WHEN valid THEN size + 11 ELSE size END)::BIGINT AS size, (SELECT 4 * count(*) FILTER (valid) FROM base) AS n FROM base")
def update_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With strict_compat: a typed condition of another kind and an unknown comparison hold for every
    row, an unknown operation changes nothing; all count."""
    store = store_of(spark, sf_dir, "part", "p_partkey", _ODD)
    updates = [scalar("size", Op.ADD, 1).where_typed("wide", Cmp.GT, 10**6), scalar("size", Op.ADD, 10).where("size", 77, 0), scalar("size", 55, 3), scalar("size", 56, 1)]
    n = affected(store, *updates, strict_compat=True)
    return shown(apply(store, *updates, strict_compat=True), "size").withColumn("n", F.lit(n).cast("bigint"))


@query(f"{_SHOP} SELECT row_id, c_row AS join_row, round(price, 4) AS price, round(bal, 4) AS bal FROM j WHERE price > 300000")
def view_unknown_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With strict_compat no row passes an unknown comparison of a view."""
    v = View("orders", BOTH, LINK, program=(Leaf(0, "price", Cmp.GT, 300000), Leaf(1, "bal", 44, 0), OR), strict_compat=True)
    return view_rows(v.refresh(shop(spark, sf_dir)))


@query(f"WITH {_SUP} SELECT row_id, valid, CASE WHEN valid THEN 5 ELSE 0 END::BIGINT AS c0, CASE WHEN valid THEN 2 ELSE 0 END::BIGINT AS c1, 102::BIGINT AS tick FROM base")
def tick_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ticks from 0, then two from 100: the cadence follows the counter."""
    s = ticking(spark, sf_dir)
    s.add_program(bump("c0"))
    s.add_program(bump("c1"), period=3, phase=2)
    s.run(3).reset_tick(100)
    return shown(s.run(2).stores[0], "c0", "c1").withColumn("tick", F.lit(s.tick_count).cast("bigint"))


@query(f"WITH {_SUP} SELECT row_id, 4::BIGINT AS c0 FROM base WHERE valid AND lvl BETWEEN 1 AND 2")
def tick_view_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ticking(spark, sf_dir)
    s.add_program(bump("c0"))
    s.add_snapshot("seen", 0, ["c0"], period=2, band=(1, 2))
    s.run(5)
    return s.snapshots["seen"].select(F.col("_row").alias("row_id"), F.col("c0").cast("bigint"))


def busy_ticks(spark: SparkSession, sf_dir: str, ticks: int, seen: Callable[[Scheduler], None] = lambda s: None) -> Scheduler:
    """Views that update, delete and insert on every tick, beside a program."""
    s = ticking(spark, sf_dir)
    s.stores[1] = Store.preallocated(spark, [ColumnSpec("c0", Kind.INT32)], 40)
    s.add_program(bump("c0"))
    s.add_view("edit", View(0, (Pick(0, "c0"),), update=(Write("c0", 0, "c0"),)))
    s.add_view("gone", View(0, (Pick(0, "c0"),), delete=(0,)))
    s.add_view("born", View(1, (Pick(0, "c0"),), insert=(Write("c0", 1, "c0"),)))
    for t in range(1, ticks + 1):
        s.tick()
        at = F.col("_base_row") % 12 == t
        s.views["edit"] = s.views["edit"].change(at, {"c0": F.lit(100)})
        s.views["gone"] = s.views["gone"].remove(at & (F.col("_base_row") % 5 == 0))
        s.views["born"] = s.views["born"].add_rows(spark.range(1).select(F.lit(0).alias("k"), F.lit(t).alias("c0")), "k")
        seen(s)
    return s


@query(
    f"WITH {_SUP}, k AS (SELECT row_id, valid, row_id % 12 AS t, row_id % 12 BETWEEN 1 AND 11 AND row_id % 5 = 0 AS gone FROM base) "
    "SELECT 0 AS store, row_id, valid AND NOT gone AS valid, CASE WHEN NOT valid THEN 0 WHEN t = 0 THEN 12 WHEN gone THEN 100 ELSE 112 - t END::BIGINT AS c0 FROM k UNION ALL SELECT 1, i, i < 11, CASE WHEN i < 11 THEN i + 1 ELSE 0 END FROM range(40) r(i)"
)
def tick_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = busy_ticks(spark, sf_dir, 12)
    return reduce(DataFrame.unionByName, [shown(s.stores[k], "c0").select(F.lit(k).alias("store"), "*") for k in (0, 1)])


@query("WITH s AS (SELECT c_nationkey::BIGINT AS k, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), t AS (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier) SELECT coalesce(t.k, s.k) AS k, round(CASE WHEN t.k IS NULL THEN 0 WHEN s.k IS NULL THEN t.bal ELSE t.bal + s.top END, 2) AS bal FROM t FULL JOIN s ON t.k = s.k")
def u_joined_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert whose source is joined with another table first."""
    target = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("k"))
    top = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("k").agg(F.max("o_totalprice").alias("top"))
    source = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.lit(0.0).alias("bal"))
    update = Upsert("k", (("bal", Binary("add", Ref("bal"), Ref("new_top"))),), joins=(EquiJoin("tops", "key", "k"),))
    return update.build(target, source, {"tops": top}).withColumn("bal", F.round("bal", 2))


@query("SELECT c_custkey AS k, round(c_acctbal * 2, 2) AS bal FROM customer WHERE c_acctbal >= 0 AND c_acctbal * 2 > 9000 UNION ALL SELECT -1 - r_regionkey, 9500.5 FROM region")
def registered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered view with its delete, update and insert; only due and dirty views are built."""
    tables_ = {"customer": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))}
    r = Registry()
    rich = Query("customer", ("k", "bal"), where=(Test("gt", "bal", 9000),))
    r.register("rich", rich, 2, Upsert("k"), Assign((("bal", Binary("mul", Ref("bal"), Const(2.0))),)), Delete((Test("lt", "bal", 0),)))
    r.register("off", rich)
    assert r.refresh(tables_, 0.0) == ["rich"] and r.refresh(tables_, 1.0) == []
    new = read(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).cast("bigint").alias("k"), F.lit(9500.5).alias("bal"))
    tables_ = r.write("rich", tables_, new)
    assert r.refresh(tables_, 0.25) == [] and r.refresh(tables_, 0.5) == ["rich"]
    return r.views["rich"].result.withColumn("bal", F.round("bal", 2))
