"""Updates, curves, noise, choices and programs on small fixtures with known results."""

import math
import struct

import pytest

from colbrook.functions.expressions import Cmp, Curve, Noise, Op, Shape, split_mix_number
from colbrook.functions.kinds import Kind, smallest_signed, smallest_unsigned
from colbrook.operators.updates import Update, affected, apply, choose, column, curved, noisy, perturbed, scalar, scaled
from colbrook.plans.program import Program, ProgramError, levels
from colbrook.sources.store import Catalog, ColumnSpec, Store


def make(spark, columns, rows, dead=(), level=None):
    store = Store.from_rows(spark, [ColumnSpec(n, k) for n, k in columns.items()], rows, valid=True)
    for d in dead:
        store = store.free(d)
    for row, lod in (level or {}).items():
        store = store.set_level(row, lod)
    return store


def values(store, *names):
    rows = store.frame.orderBy("_row").select(*names).collect()
    return [r[0] if len(names) == 1 else tuple(r) for r in rows]


@pytest.fixture(scope="module")
def hp(spark):
    return make(spark, {"hp": Kind.INT32}, [(100,), (30,), (80,), (0,)], dead=[3])


def test_scalar_operations_skip_dead_rows(hp):
    assert values(apply(hp, scalar("hp", Op.ADD, 5)), "hp") == [105, 35, 85, 0]
    assert affected(hp, scalar("hp", Op.ADD, 5)) == 3
    u = scalar("hp", Op.ADD, 100).where("hp", Cmp.LT, 50)
    assert values(apply(hp, u), "hp") == [100, 130, 80, 0] and affected(hp, u) == 1
    assert values(apply(hp.free(1), scalar("hp", Op.SET, 7)), "hp") == [7, 30, 7, 0]
    assert values(apply(hp, scalar("hp", Op.MIN, 50)), "hp") == [50, 30, 50, 0]
    assert values(apply(hp, scalar("hp", Op.MAX, 50)), "hp") == [100, 50, 80, 0]
    assert affected(hp, scalar("nothing", Op.SET, 1)) == 0 and values(apply(hp, scalar("nothing", Op.SET, 1)), "hp") == [100, 30, 80, 0]


def test_columns_scales_and_typed_conditions(spark):
    s = make(spark, {"cur": Kind.INT32, "regen": Kind.INT32, "alive": Kind.INT32}, [(100, 5, 1), (30, 10, 0), (80, 0, 1)])
    assert values(apply(s, column("cur", Op.ADD, "regen")), "cur", "regen") == [(105, 5), (40, 10), (80, 0)]
    assert values(apply(s, column("cur", Op.ADD, "regen").where("alive", Cmp.NE, 0)), "cur") == [105, 30, 80]
    p = make(spark, {"pos": Kind.FLOAT, "vel": Kind.FLOAT, "flags": Kind.INT32}, [(0.0, 10.0, 0), (5.0, -2.0, 2)])
    assert values(apply(p, scaled("pos", Op.ADD, "vel", 0.5)), "pos") == [5.0, 4.0]
    u = scalar("pos", Op.ADD, -10).where_typed("flags", Cmp.HAS_ANY, 2)
    assert values(apply(p, u), "pos") == [0.0, -5.0] and affected(p, u) == 1
    e = make(spark, {"eff": Kind.INT32, "base": Kind.INT32}, [(0, 7), (1, 10)])
    assert values(apply(e, scaled("eff", Op.ADD, "base", 3)), "eff") == [21, 31]
    with pytest.raises(ValueError):
        apply(p, scalar("pos", Op.ADD, 1).where("flags", Cmp.EQ, 0))


def test_bits(spark):
    s = make(spark, {"flags": Kind.INT32}, [(0,), (10,)])
    for op, value, want in ((Op.OR, 5, [5, 15]), (Op.AND_NOT, 1, [4, 14]), (Op.XOR, 4, [0, 10]), (Op.AND, 3, [0, 2])):
        s = apply(s, scalar("flags", op, value))
        assert values(s, "flags") == want
    f = make(spark, {"v": Kind.FLOAT}, [(3.5,)])
    assert values(apply(f, scalar("v", Op.OR, 1)), "v") == [3.5] and affected(f, scalar("v", Op.OR, 1)) == 1
    assert affected(f, scalar("v", Op.SET, 99).where("v", Cmp.HAS_ANY, 1)) == 0


def test_level_bands(spark):
    s = make(spark, {"hp": Kind.INT32}, [(100,)] * 5, level={1: 1, 2: 2, 4: 1})
    s = apply(s, scalar("hp", Op.ADD, 10).in_band(0, 1), scalar("hp", Op.SET, 7).in_band(2, 2))
    assert values(s, "hp") == [110, 110, 7, 110, 110]
    u = scaled("hp", Op.ADD, "hp", 2).in_band(0, 0)
    with pytest.raises(ValueError):
        apply(s, u)
    assert values(apply(s, u, strict_compat=True), "hp") == [220, 110, 7, 220, 110]


@pytest.mark.parametrize(
    ("metric", "curve", "want"),
    [
        ([0, 50, 100], Curve(low=0, high=100), [0, 0.5, 1]), ([-20, 50, 250], Curve(low=0, high=100), [0, 0.5, 1]), ([42, 43], Curve(low=5, high=5), [0, 0]), ([0, 25, 100], Curve(low=0, high=100, invert=True), [1, 0.75, 0]),
        ([0, 0.5, 1], Curve(Shape.POWER, p0=2), [0, 0.25, 1]), ([0, 0.5], Curve(Shape.POWER, p0=0), [1, 1]), ([0, 0.5, 1], Curve(Shape.SMOOTHSTEP), [0, 0.5, 1]), ([0, 0.5, 1], Curve(Shape.THRESHOLD, p0=0.5), [0, 1, 1]),
    ],
)
def test_curves(spark, metric, curve, want):
    s = make(spark, {"metric": Kind.FLOAT, "score": Kind.FLOAT}, [(float(m), 9.0) for m in metric])
    assert values(apply(s, curved("score", Op.SET, "metric", curve)), "score") == want


def test_curve_products_and_gates(spark):
    s = make(spark, {"metric": Kind.FLOAT, "score": Kind.FLOAT}, [(0.0, 1.0), (50.0, 1.0), (100.0, 1.0)])
    c = Curve(low=0, high=100)
    assert values(apply(s, curved("score", Op.MUL, "metric", c)), "score") == [0, 0.5, 1]
    assert values(apply(s, curved("score", Op.SET, "metric", c), curved("score", Op.MUL, "metric", Curve(low=0, high=100, invert=True))), "score") == [0, 0.25, 0]
    assert affected(s, curved("score", Op.SET, "metric", c).where("metric", Cmp.GE, 50)) == 2


def noise01(row, tick, seed):
    h = split_mix_number(seed ^ split_mix_number(row ^ split_mix_number(tick)))
    return (h >> 40) / 2**24


def test_noise_is_a_function_of_row_tick_and_seed(spark):
    assert split_mix_number(0) == 0xE220A8397B1DCDAF
    assert [noise01(r, 7, 99) for r in range(4)] == [0.50555819272995, 0.8200027942657471, 0.22038531303405762, 0.7935330867767334]
    s = make(spark, {"score": Kind.FLOAT}, [(-1.0,)] * 8, dead=[3])
    one = values(apply(s, noisy("score", Op.SET, Noise(0, 1, 99, 7))), "score")
    assert [one[r] for r in (0, 1, 2)] == [noise01(r, 7, 99) for r in range(3)] and one[3] == -1
    spread = Store(s.frame.repartition(5), s.columns, s.capacity)
    assert values(apply(spread, noisy("score", Op.SET, Noise(0, 1, 99, 7))), "score") == one
    assert all(0.25 <= v < 0.75 for i, v in enumerate(values(apply(s, noisy("score", Op.SET, Noise(0.25, 0.75, 1234))), "score")) if i != 3)
    p = make(spark, {"score": Kind.FLOAT, "variance": Kind.FLOAT}, [(10.0, v) for v in (0.0, 2.0, 0.0, 5.0)])
    got = values(apply(p, perturbed("score", Op.ADD, "variance", Noise(0, 1, 42, 1))), "score")
    assert got[0] == got[2] == 10 and math.isclose(got[1], 10 + 2 * noise01(1, 1, 42), rel_tol=1e-6)
    assert affected(p, perturbed("score", Op.ADD, "variance", Noise(0, 1, 42, 1))) == 4


def test_choices(spark):
    kinds = {"s0": Kind.FLOAT, "s1": Kind.FLOAT, "s2": Kind.FLOAT, "choice": Kind.INT32}
    pick = ("s0", "s1", "s2")
    s = make(spark, kinds, [(0.9, 0.1, 0.3, -99), (0.1, 0.1, 0.8, -99), (0.2, 0.7, 0.5, -99), (0.5, 0.5, 0.5, -99), (0.1, 0.5, 0.5, -99)])
    assert values(apply(s, choose("choice", pick)), "choice") == [0, 2, 1, 0, 1]
    low = make(spark, kinds, [(0.05, 0.02, 0.01, -99), (0.05, 0.4, 0.01, -99), (0.0, 1.0, 0.0, -99), (float("nan"), 1.0, 0.0, -99), (0.2, float("nan"), 0.1, -99)], dead=[2])
    assert values(apply(low, choose("choice", pick, 0.1, -1)), "choice") == [-1, 1, -99, -1, 0]
    assert values(apply(low, choose("choice", ())), "choice") == [-1, -1, -99, -1, -1]
    assert affected(low, choose("choice", pick)) == 4


@pytest.mark.parametrize(
    ("kind", "rows", "op", "value", "want"),
    [
        (Kind.UINT8, [5, 250], Op.ADD, 10, [15, 4]), (Kind.UINT8, [5], Op.SUB, 6, [255]), (Kind.INT8, [100], Op.ADD, 100, [-56]), (Kind.INT16, [300], Op.MUL, 300, [24464]), (Kind.UINT16, [5000, 200], Op.MIN, 1000, [1000, 200]),
        (Kind.INT32, [2**31 - 1], Op.ADD, 1, [-(2**31)]), (Kind.UINT32, [2**32 - 1], Op.MUL, 2**32 - 1, [1]), (Kind.INT64, [2**63 - 1], Op.ADD, 1, [-(2**63)]), (Kind.INT64, [2**62], Op.MUL, 4, [0]),
        (Kind.UINT64, [2**64 - 1], Op.ADD, 2, [1]), (Kind.UINT64, [2**63 + 3], Op.MUL, 3, [(2**63 + 3) * 3 % 2**64]), (Kind.UINT64, [2**64 - 1], Op.AND, 2**63 + 5, [2**63 + 5]), (Kind.UINT64, [1], Op.SUB, 2, [2**64 - 1]), (Kind.DOUBLE, [1.5], Op.ADD, 0.25, [1.75]),
    ],
)
def test_widths_wrap(spark, kind, rows, op, value, want):
    from decimal import Decimal

    s = make(spark, {"v": kind}, [(Decimal(r) if kind == Kind.UINT64 else r,) for r in rows])
    assert [type(w)(v) for v, w in zip(values(apply(s, scalar("v", op, value)), "v"), want)] == want


def test_narrowing():
    assert [smallest_unsigned(v) for v in (255, 256, 65536, 5 * 10**9)] == [Kind.UINT8, Kind.UINT16, Kind.UINT32, Kind.UINT64]
    assert [smallest_signed(-200, 100), smallest_signed(0, 40000), smallest_signed(-128, 127)] == [Kind.INT16, Kind.INT32, Kind.INT8]


def test_programs(spark, hp):
    other = make(spark, {"v": Kind.INT32}, [(r,) for r in range(50)])
    program = Program((scalar("v", Op.ADD, 10).on(1), scalar("hp", Op.ADD, 1), scalar("v", Op.MUL, 2).on(1), scalar("v", Op.SET, 0).on(9)))
    out = program.run([hp, other])
    assert values(out[1], "v") == [(r + 10) * 2 for r in range(50)] and values(out[0], "hp") == [101, 31, 81, 0]
    assert program.affected([hp, other]) == 103
    full = program.add(curved("v", Op.SET, "v", Curve(Shape.POWER, p0=2)).where("v", Cmp.GE, 3).in_band(1, 2)).add(choose("a", ("b", "c"), 0.5)).add(perturbed("a", Op.ADD, "b", Noise(1, 2, 2**63, 4)))
    assert Program.deserialise(full.serialise()) == full and len(full) == 7
    data = full.serialise()
    for bad in (None, b"", b"x", data[:-1], data + b" ", data.replace(b"CBPR", b"NOPE"), data.replace(b"CBPR 2", b"CBPR 3"), data.replace(b'"op"', b'"po"')):
        with pytest.raises(ProgramError):
            Program.deserialise(bad)
    assert values(program.run([hp, other.set_level(0, 3)], (3, 3))[1], "v")[:2] == [20, 1]


def test_levels_follow_hazards():
    a, b = scalar("a", Op.ADD, 1), scalar("b", Op.ADD, 1)
    assert levels([a, b, scalar("a", Op.MUL, 2), column("b", Op.ADD, "a"), Update("c", Op.SET, 1).on(1)]) == [0, 0, 1, 2, 0]


def test_random_programs_equal_a_row_interpreter(spark):
    import random

    r = random.Random(4)
    rows = [(r.randint(-50, 50), r.randint(-50, 50), r.randint(0, 15)) for _ in range(64)]
    s = make(spark, {"a": Kind.INT32, "b": Kind.INT32, "c": Kind.INT32}, rows, dead=[5, 9])
    tests = {Cmp.EQ: lambda x, t: x == t, Cmp.NE: lambda x, t: x != t, Cmp.LT: lambda x, t: x < t, Cmp.GE: lambda x, t: x >= t, Cmp.HAS_ANY: lambda x, t: x & t != 0, Cmp.LACKS: lambda x, t: x & t == 0, Cmp.HAS_ALL: lambda x, t: x & t == t}
    ops = {Op.SET: lambda c, x: x, Op.ADD: lambda c, x: c + x, Op.SUB: lambda c, x: c - x, Op.MIN: min, Op.MAX: max, Op.AND: lambda c, x: c & x, Op.OR: lambda c, x: c | x, Op.XOR: lambda c, x: c ^ x, Op.AND_NOT: lambda c, x: c & ~x}
    for _ in range(3):
        updates, plain, hits = [], [dict(zip("abc", v)) for v in rows], 0
        for _ in range(12):
            t, o, w = (r.choice("abc") for _ in range(3))
            op, cmp, value, limit = r.choice(list(ops)), r.choice(list(tests)), r.randint(-9, 9), r.randint(-9, 9)
            u = column(t, op, o) if r.random() < 0.5 else scalar(t, op, value)
            updates.append(u.where(w, cmp, limit))
            for i, row in enumerate(plain):
                if i not in (5, 9) and tests[cmp](row[w], limit):
                    row[t] = ops[op](row[t], row[o] if u.operand else value)
                    hits += 1
        assert values(apply(s, *updates), "a", "b", "c") == [tuple(x.values()) for x in plain]
        assert affected(s, *updates) == hits


def test_store_life(spark, tmp_path):
    columns = [ColumnSpec("idx", Kind.INT32, 2147483647), ColumnSpec("health", Kind.FLOAT, 100), ColumnSpec("id", Kind.GUID)]
    s = Store.preallocated(spark, columns, 3)
    assert (s.row_count, s.column_count, s.row_stride, s.live_count()) == (3, 3, 24, 0)
    slots, s = s.allocate()
    assert slots == [0] and (s.get(0, "idx"), s.get(0, "health"), s.is_valid(0)) == (2147483647, 100.0, True)
    more, s = s.set_level(1, 300).allocate(5)
    assert more == [1, 2] and s.level(1) == 0 and s.allocate()[0] == []
    s = s.set(1, "health", 7).set_locked(1).free(1)
    assert (s.is_valid(1), s.is_locked(1), s.get(1, "health")) == (False, False, 7.0)
    again, s = s.allocate()
    assert again == [1] and s.get(1, "health") == 100.0 and s.live_count() == 3
    assert s.get(9, "health") is None and s.try_set(9, "health", 1)[0] is False and s.try_set(0, "health", 1)[0] and s.level(9) == 0
    three = Store.from_rows(spark, [ColumnSpec("f", Kind.FLOAT), ColumnSpec("i", Kind.INT32), ColumnSpec("d", Kind.DOUBLE)], [(float(r), r, float(r)) for r in range(4)], extra=2)
    assert three.row_stride == 16 and three.live_count() == 0 and [tuple(r) for r in three.dump().collect()] == [(float(r), r, float(r)) for r in range(4)] + [(0.0, 0, 0.0)] * 2
    assert three.load([(9.0, 9, 9.0)]).row_count == 1
    three.set_valid(2).write(str(tmp_path / "s"))
    assert Store.read(spark, str(tmp_path / "s"), three.columns).live_count() == 1
    moved = Store.from_rows(spark, [ColumnSpec("a", Kind.INT16), ColumnSpec("b", Kind.INT32)], [(-1, 70000)]).convert([ColumnSpec("a", Kind.INT32), ColumnSpec("b", Kind.UINT8), ColumnSpec("z", Kind.DOUBLE, 2.5)])
    assert values(moved, "a", "b", "z") == [(65535, 70000 % 256, 2.5)]
    bits = three.convert([ColumnSpec("f", Kind.INT32), ColumnSpec("d", Kind.GUID), ColumnSpec("i", Kind.DOUBLE)])
    assert [r.f for r in bits.dump().collect()] == [0, 0x3F800000, 0x40000000, 0x40400000, 0, 0]
    assert bits.get(1, "d") == struct.pack("<dq", 1.0, 0) and bits.get(2, "i") == struct.unpack("<d", struct.pack("<q", 2))[0]
    with pytest.raises(ValueError):
        Store.from_bytes(spark, [ColumnSpec("i", Kind.INT32)], b"12345")
    with pytest.raises(ValueError):
        Store.preallocated(spark, [], 2).load_bytes(b"1")
    c = Catalog().add(s).add(three)
    assert c.column_index("d") == (1, 2) and c.column_index("none") is None and c.store_index("store") == 1
