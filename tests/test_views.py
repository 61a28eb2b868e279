"""Snapshots, views, write-back, ticks and declarative queries on small fixtures."""

import pytest
from pyspark.sql import functions as F

from colbrook.functions.expressions import Cmp, Op
from colbrook.functions.kinds import Kind
from colbrook.functions.ranks import ranked
from colbrook.operators.updates import scalar
from colbrook.operators.views import AND, NEW, NOT, OR, RANGE, Command, Join, Leaf, Pick, Scope, View, Write, run_commands, snapshot
from colbrook.plans.program import Program
from colbrook.plans.query import Query, Registry
from colbrook.sources.store import ColumnSpec, Store
from colbrook.streaming.scheduler import Scheduler, drive


def make(spark, columns, rows, extra=0, tag="store"):
    specs = [c if isinstance(c, ColumnSpec) else ColumnSpec(*c) for c in columns]
    store = Store.from_rows(spark, specs, rows, extra, valid=True, tag=tag)
    return store


def rows_of(view, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in view.data().select(*names).collect()]


@pytest.fixture(scope="module")
def actors(spark):
    return make(spark, [("health", Kind.INT32), ("faction", Kind.INT32)], [(100, 1), (30, 2), (80, 2), (10, 1)])


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ((Leaf(0, "health", Cmp.GE, 90), Leaf(0, "faction", Cmp.EQ, 2), OR), [0, 1, 2]), ((Leaf(0, "faction", Cmp.EQ, 2), NOT), [0, 3]), ((Leaf(0, "health", RANGE, 20, 90),), [1, 2]),
        ((Leaf(0, "health", Cmp.GT, 50), Leaf(0, "faction", Cmp.EQ, 1), AND, Leaf(0, "health", Cmp.EQ, 80), OR), [0, 2]), ((), [0, 1, 2, 3]), ((AND, NOT, OR), [0, 1, 2, 3]), ((Leaf(0, "health", RANGE, 90, 20),), [0, 3]),
    ],
)
def test_predicate_programs(actors, program, want):
    v = View("a", (Pick(0, "health"),), program=program).refresh({"a": actors})
    assert rows_of(v, "_base_row") == want


def test_snapshot_is_isolated(actors):
    seen = snapshot(actors, ["faction", "absent", "health"])
    later = actors.set(0, "health", 1).free(1)
    assert seen.columns == ["_row", "faction", "health"] and seen.count() == 4 and snapshot(later, ["health"]).count() == 3
    assert snapshot(actors.set_level(2, 4), ["health"], (1, 9)).collect()[0]["_row"] == 2


def test_joins_and_absence(spark):
    base = make(spark, [("idx", Kind.INT32)], [(0,), (2147483647,), (1,), (7,), (-1,)])
    magic = make(spark, [("mana", Kind.FLOAT)], [(50.0,), (75.0,)])
    stores = {"catalogue": base, "magic": magic}
    v = View("catalogue", (Pick(1, "mana"),), (Join("magic", "idx"),)).refresh(stores)
    assert rows_of(v, "mana", "_join1_row") == [(50.0, 0), (0.0, None), (75.0, 1), (0.0, None), (0.0, None)]
    over = View("catalogue", (Pick(1, "mana"),), (Join("magic", "idx"),), program=(Leaf(1, "mana", Cmp.GT, 60),)).refresh(stores)
    assert rows_of(over, "_base_row", "mana") == [(2, 75.0)]
    negated = View("catalogue", (Pick(1, "mana"),), (Join("magic", "idx"),), program=(Leaf(1, "mana", Cmp.GT, 60), NOT)).refresh(stores)
    assert rows_of(negated, "_base_row") == [0, 1, 3, 4]
    dead = View("catalogue", (Pick(1, "mana"),), (Join("magic", "idx"), Join("magic"))).refresh(stores | {"magic": magic.free(0)})
    assert rows_of(dead, "_join1_row", "_join2_row") == [(None, None), (None, 1), (1, None), (None, None), (None, None)]
    scoped = View("catalogue", (Pick(0, "idx"),), scope=(Scope("idx", Cmp.LT, 5), Scope("idx", Cmp.GE, 0))).refresh(stores)
    assert rows_of(scoped, "idx") == [0, 1]
    with pytest.raises(KeyError):
        View("catalogue", (Pick(0, "none"),)).refresh(stores)


def test_update_write_back_last_row_wins(spark):
    core = make(spark, [("health", Kind.INT32), ("shield", Kind.INT32)], [(100, 0), (50, 0), (80, 0)])
    v = View("core", (Pick(0, "health"),), update=(Write("health", "core", "shield"),)).refresh({"core": core})
    v = v.change(F.col("_base_row") == 1, {"health": F.lit(999)})
    out, _ = v.commit({"core": core})
    assert [tuple(r) for r in out["core"].dump().collect()] == [(100, 0), (50, 999), (80, 0)] and v.operations({"core": core}) == 1
    many = make(spark, [("idx", Kind.INT32), ("v", Kind.INT32)], [(0, 5), (0, 9), (2147483647, 7)])
    goal = make(spark, [("g", Kind.INT32)], [(1,), (2,)])
    w = View("many", (Pick(0, "v"),), (Join("goal", "idx"),), update=(Write("v", "goal", "g"),)).refresh({"many": many, "goal": goal}).change(F.lit(True))
    assert [r[0] for r in w.commit({"many": many, "goal": goal})[0]["goal"].dump().collect()] == [9, 2] and w.operations({"many": many, "goal": goal}) == 2


def test_insert_delete_and_links(spark):
    empty = Store.preallocated(spark, [ColumnSpec("health", Kind.INT32)], 4)
    v = View("e", (Pick(0, "health"),), insert=(Write("health", "e", "health"),)).refresh({"e": empty})
    v = v.add_rows(spark.createDataFrame([(1, 42)], "k long, health int"), "k")
    assert v.operations({"e": empty}) == 1 and rows_of(v, "_state") == [NEW]
    out, after = v.commit({"e": empty})
    assert out["e"].live_count() == 1 and out["e"].get(0, "health") == 42 and rows_of(after, "_base_row") == [0]
    live = make(spark, [("health", Kind.INT32)], [(1,), (2,), (3,)])
    d = View("l", (Pick(0, "health"),), delete=("l",)).refresh({"l": live}).remove(F.col("_base_row") == 1)
    gone = d.commit({"l": live})[0]["l"]
    assert (gone.live_count(), gone.is_valid(1), gone.get(1, "health"), d.operations({"l": live})) == (2, False, 2, 1)
    catalogue = Store.preallocated(spark, [ColumnSpec("idx", Kind.INT32, 2147483647)], 3)
    trait = make(spark, [("power", Kind.INT32)], [(5,)], extra=1).set_valid(1, False)
    stores = {"catalogue": catalogue, "trait": trait}
    w = View("catalogue", (Pick(1, "power"),), (Join("trait", "idx"),), insert=(Write("power", "trait", "power"), Write("power", "catalogue", "idx"))).refresh(stores)
    w = w.add_rows(spark.createDataFrame([(1, 42), (2, 43)], "k long, power int"), "k")
    out, after = w.commit(stores)
    assert (out["catalogue"].get(0, "idx"), out["trait"].get(1, "power"), out["trait"].live_count()) == (1, 42, 2)
    assert out["catalogue"].get(1, "idx") == 43 and w.operations(stores) == 4
    assert rows_of(after, "_base_row", "_join1_row") == [(0, 1), (1, None)]


def counters(spark, n=6):
    return make(spark, [(f"c{i}", Kind.INT32) for i in range(3)], [(0, 0, 0)] * n)


def bump(name):
    return Program((scalar(name, Op.ADD, 1),))


def test_ticks(spark, tmp_path):
    s = Scheduler({0: counters(spark)}, cut_every=4)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    s.add_program(bump("c0"))
    s.add_program(bump("c1"), period=4)
    s.add_program(bump("c2"), period=4, phase=1)
    assert s.program_count == 3 and s.run(8).tick_count == 8
    assert tuple(s.stores[0].dump().first()) == (8, 2, 2)
    s.clear_programs()
    s.reset_tick()
    t = Scheduler({0: counters(spark, 50)})
    t.add_program(bump("c0"))
    t.add_program(bump("c1"), period=2)
    assert [t.tick(True), t.tick(True)] == [50, 100]
    lod = counters(spark)
    for r in range(6):
        lod = lod.set_level(r, r % 3)
    u = Scheduler({0: lod}, cut_every=0)
    u.add_program(bump("c0"), band=(0, 0))
    u.add_program(bump("c0"), period=4, band=(2, 2))
    assert [r[0] for r in u.run(4).stores[0].dump().collect()] == [4, 0, 1, 4, 0, 1]


def test_tick_order(spark):
    s = Scheduler({0: counters(spark, 3)})
    s.add_program(bump("c0"))
    s.add_snapshot("seen", 0, ["c0"], period=3)
    s.add_view("edit", View(0, (Pick(0, "c0"),), update=(Write("c0", 0, "c0"),)))
    s.run(2)
    assert s.snapshots["seen"] is None and rows_of(s.views["edit"], "c0") == [2, 2, 2]
    s.views["edit"] = s.views["edit"].change(F.col("_base_row") == 1, {"c0": F.lit(50)})
    s.tick()
    assert [r[0] for r in s.snapshots["seen"].orderBy("_row").select("c0").collect()] == [3, 51, 3]
    assert s.snapshot_count == 1 and s.view_count == 1


def test_ranks_span_buckets(spark):
    keys = [0, 5, 1 << 20, (1 << 20) + 7, 1 << 40]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k long")
    assert [r.r for r in ranked(df, "k", "r").orderBy("k").collect()] == [0, 1, 2, 3, 4]


def test_registry(spark, actors):
    r = Registry()
    r.register("off", Query("a"), 0)
    r.register("always", Query("a", ("health",)), 255)
    r.register("slow", Query("a"), 2)
    tables = {"a": actors.frame}
    assert r.refresh(tables, 0.0) == ["always", "slow"] and r.refresh(tables, 1.0) == []
    r.mark_dirty("slow")
    assert r.refresh(tables, 0.1) == [] and r.refresh(tables, 0.6) == ["slow"]
    assert r.views["always"].result.columns == ["health"]


def test_commands(spark):
    s = make(spark, [("a", Kind.INT32), ("b", Kind.INT32, 7)], [(1, 1), (2, 2)], extra=2).set_valid(F.col("_row") >= 2, False)
    orders = [Command("s", "a", 0, 10), Command("s", "a", 0, 11), Command("s", "b", "x", 5), Command("s", "a", "x", 6), Command("s", "a", "y", 8), Command("s", "a", "z", 9), Command("t", "a", 0, 1), Command("s", "none", 0, 1)]
    out, rows = run_commands({"s": s}, orders)
    assert rows == {("s", "x"): 2, ("s", "y"): 3}
    assert [tuple(r) for r in out["s"].dump().collect()] == [(11, 1), (2, 2), (6, 5), (8, 7)] and out["s"].live_count() == 4


def test_ticks_driven_by_a_stream(spark):
    import time

    s = Scheduler({0: counters(spark, 3)}, cut_every=0)
    s.add_program(bump("c0"))
    stream = drive(spark, s, rows_per_second=5, ticks=3)
    until = time.time() + 60
    while s.tick_count < 3 and time.time() < until:
        time.sleep(0.2)
    stream.stop()
    assert [r[0] for r in s.stores[0].dump().collect()] == [3, 3, 3]


@pytest.mark.parametrize("parts", [1, 8])
def test_views_do_not_depend_on_the_layout(spark, actors, parts):
    spread = Store(actors.frame.repartition(parts).orderBy(F.rand(3)), actors.columns, actors.capacity)
    v = View("a", (Pick(0, "health"),), scope=(Scope("health", Cmp.GT, 20),), update=(Write("health", "a", "faction"),)).refresh({"a": spread}).change(F.col("health") > 50)
    assert [tuple(r) for r in v.commit({"a": spread})[0]["a"].dump().collect()] == [(100, 100), (30, 2), (80, 80), (10, 1)]
