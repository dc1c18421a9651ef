"""Full reload with resume, run history, and case folding."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest

from tallymark.functions.normalize import folded
from tallymark.operators.reload import ReloadBroken, journal, published, reload_all, reload_gate, stage_levels
from tallymark.plans.suite import run_suite
from tallymark.registry.derive import L1, L2, L3, reload_pipeline
from tallymark.sources.history import check_history, history, record_run
from tallymark.sources.tables import TableStore
from tallymark.spec import ForeignKeySpec, LookupSpec

ON = datetime(2024, 1, 1)


@pytest.fixture
def sources(spark):
    return {
        "customer": spark.createDataFrame([(1, " ann ", 1, 5.0, "x"), (2, "bob", 1, -5.0, "y")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": spark.createDataFrame([(7, "s", 1, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "orders": spark.createDataFrame([(5, 1, "O", 9000.0, ON, "1-A"), (6, 2, "o", 1.0, ON, "1-A")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": spark.createDataFrame([(5, 1, 7, 9.0, 2.0), (6, 1, 7, 9.0, 3.0), (5, 2, 8, 1.0, 1.0)], "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double"),
    }


def names_of(levels):
    return [sorted(s.output[1] for s in level) for level in levels]


def test_stages_wait_for_what_they_need():
    assert names_of(stage_levels(reload_pipeline())) == [
        ["ps_customer", "ps_lineitem", "ps_orders", "ps_supplier"],
        ["stg_customer", "stg_lineitem", "stg_orders", "stg_supplier"],
        ["dim_customer", "dim_orders", "dim_supplier"],
        ["fact_lineitem"],
    ]


def test_cycles_of_foreign_keys_load_and_cycles_of_lookups_do_not():
    spec = reload_pipeline()
    layer = spec.layer(L1)

    def with_links(**links):
        tables = {name: replace(table, **links.get(name, {})) for name, table in layer.tables.items() if name in ("Orders", "Customers")}
        return replace(spec, layers={L1: replace(layer, tables=tables)})

    to_customer, to_orders = ForeignKeySpec("k", "ps_customer", "k"), ForeignKeySpec("k", "ps_orders", "k")
    linked = with_links(Orders={"foreign_keys": (to_customer,)}, Customers={"foreign_keys": (to_orders,)})
    assert names_of(stage_levels(linked)) == [["ps_customer", "ps_orders"]]
    looked = with_links(Orders={"lookups": (LookupSpec("k", "ps_customer", "k", "s"),)}, Customers={"lookups": (LookupSpec("k", "ps_orders", "k", "s"),)})
    with pytest.raises(ValueError, match="need each other"):
        stage_levels(looked)


def test_a_broken_reload_goes_on_where_it_stopped(spark, sources, tmp_path):
    root, spec = str(tmp_path), reload_pipeline()
    without = {**sources, "lineitem": sources["lineitem"].drop("l_suppkey")}  # only the lookup of the fact misses it
    with pytest.raises(ReloadBroken, match="dwh.fact_lineitem"):
        reload_all(spark, spec, without, root, "r1", ON)
    assert published(spark, root) is None
    before = {(r["table"], r["written_at"]) for r in journal(spark, root, "r1").collect()}
    assert len(before) == 11 and "fact_lineitem" not in dict(before)

    with pytest.raises(ReloadBroken):  # the finished copies of the broken input are kept, as the name of the run says
        reload_all(spark, spec, sources, root, "r1", ON)
    store = reload_all(spark, spec, sources, root, "r2", ON)
    assert store.table("dwh", "fact_lineitem").collect() == published(spark, root).table("dwh", "fact_lineitem").collect()
    assert [tuple(r) for r in store.table("dwh", "dim_customer").select("CustomerSK", "c_custkey", "c_name", "IsCurrent").collect()] == [(1, 1, "ANN", 1)]
    rows = {r["table"]: r["row_count"] for r in journal(spark, root, "r2").collect()}
    assert rows["ps_orders"] == 2 and rows["dim_orders"] == 1 and rows["fact_lineitem"] == 2
    assert {(r["table"], r["written_at"]) for r in journal(spark, root, "r1").collect()} == before


def test_a_repaired_stage_is_written_anew_and_others_are_kept(spark, sources, tmp_path):
    root, spec = str(tmp_path), reload_pipeline()
    items = spec.table(L3, "Items")
    broken = replace(items, lookups=(replace(items.lookups[0], ref_key="absent"), *items.lookups[1:]))
    worse = replace(spec, layers={**spec.layers, L3: replace(spec.layer(L3), tables={**spec.layer(L3).tables, "Items": broken})})
    with pytest.raises(ReloadBroken, match="absent"):
        reload_all(spark, worse, sources, root, "r1", ON)
    times = {r["table"]: r["written_at"] for r in journal(spark, root, "r1").collect()}
    reload_all(spark, spec, sources, root, "r1", ON)
    after = {r["table"]: r["written_at"] for r in journal(spark, root, "r1").collect()}
    assert len(after) == 12 and {t: at for t, at in after.items() if t in times} == times
    again = reload_all(spark, spec, {}, root, "r1", ON)  # published: nothing is loaded
    assert again.table("dwh", "fact_lineitem").count() == 2

    changed = {**sources, "customer": sources["customer"].selectExpr("c_custkey", "c_name", "c_nationkey", "9.0D as c_acctbal", "c_mktsegment")}
    later = reload_all(spark, spec, changed, root, "r2", datetime(2024, 2, 1), previous=published(spark, root))
    assert later.table("dwh", "dim_customer").where("IsCurrent = 0").count() == 1
    assert published(spark, root, "r1").table("dwh", "dim_customer").count() == 1
    assert published(spark, root).table("dwh", "dim_customer").count() == 3


def test_the_reload_is_a_gate(spark, sources, tmp_path):
    spec = reload_pipeline()
    store = TableStore(spark)
    run = run_suite(store, spec, only=["count_check"], gate=reload_gate(store, spec, sources, str(tmp_path), "r1", ON))
    found = {(r["layer"], r["table"]): (r["status"], r["message"]) for r in run.results.where("status <> 'SKIP'").collect()}
    assert found["Prerequisite", "ALL"] == ("PASS", "12 tables reloaded")
    assert found[L2, "Orders"] == ("PASS", "source=2, target=2, diff=0") and len(found) == 13

    empty = TableStore(spark)
    less = {name: df for name, df in sources.items() if name != "supplier"}
    run = run_suite(empty, spec, gate=reload_gate(empty, spec, less, str(tmp_path), "r2", ON))
    outcome = run.results.where("status <> 'SKIP'").collect()
    assert [r["status"] for r in outcome] == ["FAIL"] and outcome[0]["message"].startswith("reload stopped at prestaging.ps_supplier")


def results(spark, *rows):
    return spark.createDataFrame(rows, "layer string, `table` string, validation string, status string")


def test_history_keeps_runs_apart(spark, tmp_path):
    root = str(tmp_path)
    record_run({"results": results(spark, ("a", "t", "v", "PASS"), ("b", "t", "v", "FAIL")), "totals": spark.range(1)}, root, "001", ON)
    for status in ("FAIL", "PASS"):
        record_run({"results": results(spark, ("a", "t", "v", status), ("a", "u", "v", "ERROR"))}, root, "002", datetime(2024, 1, 2))
    record_run({"results": results(spark, ("b", "t", "v", "PASS")).selectExpr("*", "1 as extra")}, root, "003", datetime(2024, 1, 3))
    found = history(spark, root, "results")
    assert sorted((r["run"], r["layer"], r["table"], r["status"], r["extra"]) for r in found.collect()) == [
        ("001", "a", "t", "PASS", None), ("001", "b", "t", "FAIL", None),
        ("002", "a", "t", "PASS", None), ("002", "a", "u", "ERROR", None), ("003", "b", "t", "PASS", 1),
    ]
    changes = {(r["run"], r["layer"], r["table"]): r["change"] for r in check_history(found).collect()}
    assert changes == {
        ("001", "a", "t"): "new", ("001", "b", "t"): "new", ("002", "a", "t"): "same", ("002", "a", "u"): "new", ("003", "b", "t"): "fixed",
    }
    assert history(spark, root, "totals").collect()[0]["run"] == "001"
    with pytest.raises(ValueError, match="run"):
        record_run({"x": spark.range(1).withColumnRenamed("id", "run")}, root, "004", ON)


def test_folding_joins_the_same_letters_as_full_case_folding(spark):
    points = [c for c in [*range(0x20, 0x2C00), *range(0xA640, 0xAC00), *range(0xFB00, 0xFB20), *range(0x10400, 0x10600)] if chr(c).isalpha()]
    texts = [chr(c) for c in points] + ["straße", "STRASSE", "ΟΔΟΣ", "οδος", "ﬁn", "FIN"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{folded('t')} as f").collect()
    spark_class, python_class = {}, {}
    for r in found:
        spark_class.setdefault(r["f"], set()).add(r["t"])
        python_class.setdefault(r["t"].casefold(), set()).add(r["t"])
    assert {frozenset(s) for s in spark_class.values()} == {frozenset(s) for s in python_class.values()}
