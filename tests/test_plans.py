"""Plans stay the ones that scale: no shuffle in updates, pruned scans, generated code."""

import os

import pytest

from colbrook.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sys_scalar_add_pred", "sys_column_add", "sys_lod_band", "curve_product", "noise_perturb", "argmax_floor", "batch_conflict_order", "utility_ai_decide", "dataview_lod_band", "tick_lod_tiers", "wide_uint64_mul"])
def test_updates_and_snapshots_do_not_shuffle(spark, name):
    text = plan(spark, name)
    assert "Exchange" not in text and "Python" not in text and "Sort" not in text


def test_scans_read_only_named_columns(spark):
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan(spark, "sys_add")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan(spark, "view_scope")


def test_scope_is_pushed_to_the_scan(spark):
    text = plan(spark, "view_scope")
    assert "GreaterThan(o_totalprice,200000.0)" in text


def test_limits_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(spark, "q_sort_limit_offset")


def relations(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text.count("Relation [") + text.count("LogicalRDD") + text.count("Range (")


def test_plans_and_tables_do_not_grow_with_the_ticks(spark, tmp_path):
    """Thirty ticks with views that update, delete and insert on each of them."""
    from colbrook.queries import busy_ticks
    from colbrook.sources.shared import WRITTEN, shared_folder

    sizes, tables, before = [], [], len(WRITTEN)

    def seen(s):
        sizes.append(sum(relations(x.frame) for x in s.stores.values()) + sum(relations(v.rows) for v in s.views.values()))
        tables.append(len(WRITTEN) - before)

    busy_ticks(spark, SF, 30, seen)
    assert max(sizes[10:]) <= max(sizes[:10]) <= 60 and max(tables) <= 20
    assert shared_folder(spark)
