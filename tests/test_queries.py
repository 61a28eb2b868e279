"""Every named query against DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from colbrook.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, oracle, name):
    assert name in ORACLES
    df = QUERIES[name](spark, SF)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    answer = oracle.sql(ORACLES[name])
    names = answer.columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in answer.fetchall())
    assert sorted(df.columns) == sorted(names) and got == want


def test_narrow_index_of_large_keys_keeps_low_bytes(spark, oracle, tmp_path):
    """Keys beyond INT16, at which the SQL's own CAST raises; it gives the same rows for those within."""
    keys = [*range(650), 33_367, 33_368, 66_135, 40_051, 66_136, 66_137, 66_786, 899_999]
    spark.createDataFrame([(i, k, 0.0) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k / 4, 1) for k in (*range(700), 32_768, 65_535)], "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = [tuple(r) for r in QUERIES["view_join_narrow_index"](spark, str(tmp_path)).orderBy("row_id").collect()]
    held = {k for k in (*range(700), 32_768, 65_535) if k % 10 != 3}
    want = []
    for row, key in enumerate(keys):
        a, b = (key % 256 - 128) % 256, (key - 600) % 65_536
        a = a if a in held and a != 255 else None
        want += [(row, a, (a or 0) / 4, b if b in held else None)] if row % 10 != 3 else []
    assert got == want and {b for row, _, _, b in got if row >= 650} == {None, 32_768, 65_535, 0, 1, 650}
    c = oracle.cursor()
    c.execute(f"CREATE TEMP VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet' WHERE o_custkey < 33368")
    c.execute(f"CREATE TEMP VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    answer = c.execute(f"SELECT row_id, a_row, a_bal, b_row FROM ({ORACLES['view_join_narrow_index']}) ORDER BY row_id").fetchall()
    assert answer == [r for r in want if keys[r[0]] < 33_368]
