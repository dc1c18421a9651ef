"""Every registered query against its SQL in DuckDB, and the shape of the plans."""

from __future__ import annotations

import os

import pytest
from conftest import rows_of

import __spark_entry__ as registered
from tallymark.registry.queries import queries as own_queries

DATA = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "supplier"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def comparable(rows, columns):
    def value(v):
        return round(v, 9) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(own_queries()))
def test_query_matches_sql(spark, duck, name):
    found = registered.queries()[name](spark, DATA)
    cursor = duck.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparable(found.collect(), found.columns) == comparable(cursor.fetchall(), columns)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(own_queries()) <= set(registered.oracle_sql())


def test_flagship(spark):
    assert rows_of(registered.entry(spark).select("diffs", "missing_in_target", "duplicates")) == [(76, 30, 28)]


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(registered.queries()["scan_filtered"](spark, DATA))
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]


def test_comparison_shuffles_both_tables_once(spark):
    plan = plan_of(registered.queries()["comparison_summary"](spark, DATA))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_plans_stay_in_the_jvm_and_avoid_products(spark):
    for name in ("results_ordered", "failure_records", "findings", "load_reject", "load_fact", "duplicate_rows"):
        plan = plan_of(registered.queries()[name](spark, DATA))
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
            assert operator not in plan, (name, operator)


def test_failure_records_hold_every_comparison(spark):
    found = registered.queries()["failure_records"](spark, DATA)
    assert "Limit" not in plan_of(found)
    assert found.where("layer like '%DWH%' and validation = 'ColumnValues_Check'").count() > 0


def test_plan_of_lookups_grows_linearly(spark):
    from tallymark.operators.loads import load_fact
    from tallymark.spec import LookupSpec

    def scans(k: int) -> int:
        rows = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr(*[f"l_orderkey + {i} as k{i}" for i in range(k)])
        names = {f"d{i}": spark.range(9).selectExpr(f"id as r{i}", f"id * 2 as s{i}") for i in range(k)}
        found = load_fact(rows, [LookupSpec(f"k{i}", f"d{i}", f"r{i}", f"s{i}") for i in range(k)], names)
        return plan_of(found).count("FileScan")

    assert [scans(k) for k in (1, 4, 10)] == [1, 1, 1]


def test_reports_leave_nothing_cached(spark):
    for name in ("failure_records", "findings", "tickets"):
        registered.queries()[name](spark, DATA).count()
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0, name


def test_detail_records_with_any_limit(spark):
    """The limit is kept in the tasks before the shuffle; a large one shows every record, as many as ``failure_records`` has."""
    from tallymark.plans.failures import detail_records, failure_records
    from tallymark.plans.suite import run_suite
    from tallymark.registry import derive

    run = run_suite(derive.store(spark, DATA), derive.pipeline(), keep_issues=True)
    assert "WindowGroupLimit" in plan_of(detail_records(run, 3))
    every = detail_records(run, 10**9).groupBy("table").agg({"rank": "max", "total": "max", "left_out": "max"}).collect()
    for table, rows in ((r["table"], r) for r in every):
        n = failure_records(run, table).count()
        assert (rows["max(rank)"], rows["max(total)"], rows["max(left_out)"]) == (n, n, 0)
    shown = {tuple(r) for r in detail_records(run, 3).groupBy("table", "left_out").count().collect()}
    assert shown == {(r["table"], r["max(total)"] - 3, 3) for r in every}


def test_few_detail_records_are_taken_without_sorting_all(spark):
    from tallymark.plans.failures import detail_records
    from tallymark.plans.suite import run_suite
    from tallymark.registry import derive

    run = run_suite(derive.store(spark, DATA), derive.pipeline(), keep_issues=True)
    assert "TakeOrderedAndProject" in plan_of(detail_records(run, 3))
    assert "TakeOrderedAndProject" not in plan_of(detail_records(run, 10**9))
