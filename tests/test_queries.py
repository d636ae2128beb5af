"""Every query of the engine against its SQL, and properties of plans."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from slidestream import queries as engine


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


def compare(spark, duck, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), name
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cols = list(rel.columns)
    want = sorted(tuple(normal(r[cols.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want, name


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query(spark, duck, small, name):
    compare(spark, duck, name, engine.QUERIES[name], engine.ORACLE_SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_rows(spark, small, name):
    assert engine.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scan_is_pruned_and_filtered(spark, small):
    p = plan(engine.window_join_flagship(spark, small))
    assert "PushedFilters: [Or(" in p or "PushedFilters: [In(" in p or "PushedFilters: [IsNotNull" in p or "PushedFilters: [EqualTo" in p
    scans = [x for x in p.splitlines() if "FileScan" in x]
    assert scans and all("event_id" not in x.split("ReadSchema")[1] for x in scans)


def test_flagship_has_no_python_and_no_join(spark, small):
    physical = plan(engine.window_join_flagship(spark, small)).split("== Physical Plan ==")[1]
    assert "Join" not in physical and "Python" not in physical and "Arrow" not in physical and "Pandas" not in physical


def test_panes_reduce_before_copies(spark, small):
    physical = plan(engine.sliding_agg_pane(spark, small)).split("== Physical Plan ==")[1]
    copies, partial = physical.index("Generate explode"), physical.rindex("Exchange")
    assert copies < partial  # the copies stand above the first exchange


def test_whole_joins_equal_brute_force(spark, tmp_path):
    """Lines of any flag, quantity and order status are joined."""
    orders = [(k, k * 10, "FOP"[k % 3]) for k in range(6)]
    lines = [(k % 7, k, 1 + k % 4, k % 3, float(k), "RAN"[k % 3]) for k in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["hash_join_one_to_many"](spark, str(tmp_path)).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")
    assert sorted(map(tuple, got.collect())) == sorted((o, c, n, q) for o, c, _ in orders for k, n, _, _, q, _ in lines if o == k)
    pairs = Counter((a[2], b[3]) for a in lines for b in lines if a[2] == b[2])
    got = entry.queries()["hash_join_many_to_many"](spark, str(tmp_path)).collect()
    assert {(r.l_partkey, r.l_suppkey): r.n for r in got} == pairs and len(got) == len(pairs)
