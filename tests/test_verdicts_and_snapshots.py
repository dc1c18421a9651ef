"""Timed runs, verdicts that end early, bucketed snapshots, linked restores and exact samples."""

from __future__ import annotations

import pytest
from conftest import rows_of

from tallymark.operators.bucketed import compare_bucketed, write_bucketed
from tallymark.operators.compare import compare
from tallymark.operators.defects import Defect, inject_exactly, negative_count
from tallymark.operators.sampling import exact_sample, hash_thresholds
from tallymark.plans import checks
from tallymark.plans.checks import CheckContext
from tallymark.plans.observed import ObservedStore
from tallymark.plans.results import run_totals
from tallymark.plans.suite import run_suite
from tallymark.plans.verdicts import verdict
from tallymark.sources.snapshot import Link, RestoreRefused, read_snapshot, restore_linked, restore_order, write_snapshot
from tallymark.sources.tables import TableStore
from tallymark.spec import LayerSpec, PipelineSpec, RuleSpec, TableSpec


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def store_of(spark, source, target):
    store = TableStore(spark)
    store.register("a", "s", source)
    store.register("b", "t", target)
    return store


def test_a_timed_run_measures_each_check(spark):
    table = TableSpec("T", "s", "t", key=("k",), compare_columns=("v",), not_null_columns=("v",), transformations=(RuleSpec("w", "min_value", 0),))
    spec = PipelineSpec(layers={"L": LayerSpec("L", "a", "b", {"T": table}, valid_filter="k < 90")})
    store = store_of(spark, spark.range(100).selectExpr("id as k", "id as v"), spark.range(95).selectExpr("id as k", "id as v"))
    run = run_suite(store, spec, timed=True)
    read = {r["validation"]: r["rows_read"] for r in run.volumes(spark).collect()}
    assert read[checks.COUNT] == 195 and read[checks.NULL] == 90 and read[checks.METADATA] == 0 and read[checks.INTEGRITY] == 190
    assert checks.TRANSFORMATION not in read  # its column is absent: an ERROR row without a volume
    found = run.results.select("validation", "status", "duration").collect()
    times = [r["duration"] for r in found if r["status"] != "ERROR"]
    assert len(set(times)) == len(times) and all(t > 0 for t in times)
    assert run_totals(run.results).first()["duration"] == pytest.approx(sum(times))
    fused = run_suite(store, spec, only=["count_check", "null_check"]).results.where("status <> 'SKIP'").collect()
    assert len([r for r in fused if r["duration"] is not None]) == 1


def test_a_failing_verdict_reads_little(spark):
    rows = spark.range(0, 1_000_000, 1, 50).selectExpr("id as k", "if(id % 1000 = 7, null, id) as v")
    table = TableSpec("T", "s", "t", key=("k",), compare_columns=("v",), not_null_columns=("v",))
    store = ObservedStore(store_of(spark, rows, rows))
    ctx = CheckContext(store, LayerSpec("L", "a", "b", {"T": table}), table)
    assert verdict(ctx, checks.NULL) == "FAIL" and store.rows_read() <= 20_000
    assert verdict(CheckContext(store_of(spark, rows, rows), ctx.layer, table), checks.CONSTRAINT) == "PASS"
    empty = rows.where("false")
    for check in (checks.NULL, checks.DUPLICATE, checks.CONSTRAINT, checks.INTEGRITY, checks.COUNT):
        assert verdict(CheckContext(store_of(spark, empty, empty), ctx.layer, table), check) == "PASS"


def test_bucketed_snapshots_meet_without_a_shuffle(spark, tmp_path):
    schema = "a string, b long, v double, w string"
    source = [("x", 1, 1.0, "p"), (" x ", 2, 2.0, "q"), (None, 3, 3.0, "r"), ("", 4, None, "s"), ("y", 5, 5.0, "t"), ("y", 5, 5.0, "u"), ("1:", 1, 0.0, "z")]
    target = [("x", 1, 1.5, "p"), ("x", 2, 2.0, "Q"), ("", 3, 3.0, "r"), (None, 4, None, "s"), ("z", 5, 5.0, "t"), ("1", 11, 0.0, "z")]
    left, right = spark.createDataFrame(source, schema), spark.createDataFrame(target, schema)
    keys, columns = ["a", "b"], ["v", "w"]
    for rows, name in ((left, "bucketed_left"), (right, "bucketed_right"), (left.where("false"), "bucketed_none")):
        spark.sql(f"drop table if exists {name}")
        write_bucketed(rows, name, keys, 4, str(tmp_path / name))
    try:
        plain, found = compare(left, right, keys, columns), compare_bucketed(spark, "bucketed_left", "bucketed_right", keys, columns)
        for part in ("diffs", "missing_in_target", "missing_in_source", "summary", "duplicates"):
            assert rows_of(getattr(found, part)()) == rows_of(getattr(plain, part)()), part
        for frame in (found.diffs(), found.missing_in_source()):
            assert "Exchange" not in plan_of(frame) and "Bucketed: true" in plan_of(frame)
        assert plan_of(found.summary()).count("Exchange") == 1  # the one row of counts
        nothing = compare_bucketed(spark, "bucketed_none", "bucketed_right", keys, columns)
        assert nothing.missing_in_source().count() == len(target)
        with pytest.raises(ValueError, match="taken"):
            write_bucketed(left.withColumn("__key", left["a"]), "bucketed_bad", keys, 4)
    finally:
        for name in ("bucketed_left", "bucketed_right", "bucketed_none"):
            spark.sql(f"drop table if exists {name}")


def test_linked_tables_are_restored_in_order_or_not_at_all(spark, tmp_path):
    links = [Link("c", "p", "p", "k"), Link("g", "c", "c", "k"), Link("p", "boss", "p", "k")]
    assert restore_order(["g", "c", "p"], links) == ["p", "c", "g"]
    with pytest.raises(ValueError, match="circle"):
        restore_order(["c", "p"], [*links, Link("p", "c", "c", "k")])
    tables = {
        "g": spark.createDataFrame([(1, 10)], "k int, c int"),
        "c": spark.createDataFrame([(10, 100), (11, None)], "k int, p int"),
        "p": spark.createDataFrame([(100, 100), (101, None)], "k int, boss int"),
    }
    root, home = str(tmp_path / "golden"), str(tmp_path / "home")
    write_snapshot(tables, root)
    found = restore_linked(spark, root, ["g", "c", "p"], home, links)
    assert list(found) == ["p", "c", "g"] and {n: rows_of(df) for n, df in found.items()} == {n: rows_of(df) for n, df in tables.items()}
    write_snapshot({**tables, "c": tables["c"].where("k > 10")}, str(tmp_path / "bad"))
    with pytest.raises(RestoreRefused, match="'g'") as refused:
        restore_linked(spark, str(tmp_path / "bad"), ["g", "c", "p"], home, links)
    assert rows_of(refused.value.orphans) == [("g", "c", "10", 1)]
    assert read_snapshot(spark, home, ["c"])["c"].count() == 2  # nothing was touched
    with pytest.raises(ValueError, match="not restored"):
        restore_linked(spark, root, ["g", "c"], home, links)


@pytest.mark.parametrize("n", [0, 5, 25, 3000])
def test_exact_numbers_of_rows(spark, n):
    rows = spark.range(n).selectExpr("id as k", "cast(id as string) as name")
    for k in (0, 1, 7, 2999):
        assert exact_sample(rows, ["k"], k).count() == min(k, n)
    first = rows_of(exact_sample(rows.repartition(7), ["k"], 7, seed=3))
    assert first == rows_of(exact_sample(rows, ["k"], 7, seed=3))
    counts = [(Defect("", "name", "'x'", "bad"), 8), (Defect("", "name", "upper(name)", "odd", negative=False), 17)]
    found = inject_exactly(rows, ["k"], counts)
    assert tuple(negative_count(found).first()) == (n, min(8, n))
    assert found.where("_note is not null").count() == min(25, n)


def test_repeated_keys_cannot_be_told_apart(spark):
    with pytest.raises(ValueError, match="share the keys"):
        hash_thresholds(spark.range(10).selectExpr("1 as k"), ["k"], [4])
