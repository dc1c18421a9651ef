"""Hot keys, lookups, numbering, foreign keys, loads, sources."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows_of
from pyspark.sql import types as T

from tallymark.functions.normalize import as_text
from tallymark.operators import loads
from tallymark.operators.defects import negative_count
from tallymark.operators.duplicates import mark_first
from tallymark.operators.foreign_keys import foreign_key_counts, orphan_rows
from tallymark.operators.lookup import lookup
from tallymark.operators.numbering import number_rows
from tallymark.plans.catalogue import case_prefixes
from tallymark.sources.metadata import column_metadata, column_profile, fallback_metadata
from tallymark.sources.snapshot import read_snapshot, restore_snapshot, write_outputs, write_snapshot
from tallymark.sources.tables import TableStore
from tallymark.spec import LayerSpec, PipelineSpec, RuleSpec, TableSpec


def test_mark_first_with_hot_and_null_keys(spark):
    rows = spark.range(900).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('k', id % 50) else null end as k", "id % 10 as v"
    )
    for hot_rows in (1, 50, 1_000_000):
        marked = mark_first(rows.repartition(6), ["k"], ["v"], hot_rows)
        assert marked.count() == 900
        firsts = marked.where("_first")
        assert firsts.count() == rows.select("k").distinct().count()
        # the first row really is the smallest
        smallest = {r["k"]: r["v"] for r in rows.groupBy("k").agg({"v": "min"}).toDF("k", "v").collect()}
        assert {r["k"]: r["v"] for r in firsts.collect()} == smallest


def test_lookup_with_frequent_missing_and_null_keys(spark):
    rows = spark.range(600).selectExpr("id", "case when id % 3 = 0 then 7 when id % 3 = 1 then id % 20 end as fk")
    reference = spark.range(10).selectExpr("id as ref", "id * 100 as sk", "concat('n', id) as name")
    expected = rows_of(rows.join(reference, rows.fk == reference.ref, "left").select("id", "fk", "sk", "name"))
    found = lookup(rows, "fk", reference, "ref", {"sk": "sk", "name": "name"})
    assert rows_of(found) == expected


def test_number_rows_is_consecutive_and_ordered(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(7)
    numbered = number_rows(rows, ["v"], "nr", start=50)
    assert rows_of(numbered.selectExpr("nr - v as d").distinct()) == [(51,)]
    assert numbered.count() == 1000
    assert number_rows(rows.where("v < 0"), ["v"], "nr").count() == 0


def test_foreign_keys(spark):
    fact = spark.sql("select * from values (1), (1), (2), (9), (9), (null) as t(fk)")
    dimension = spark.sql("select * from values (1), (2), (3) as t(id)")
    with_null = spark.sql("select * from values (1), (2), (null) as t(id)")
    assert tuple(foreign_key_counts(fact, "fk", dimension, "id").first()) == (2, 1)
    assert tuple(foreign_key_counts(fact, "fk", with_null, "id").first()) == (2, 1)
    assert tuple(foreign_key_counts(fact, "fk", with_null, "id", null_aware=True).first()) == (0, 1)
    assert tuple(foreign_key_counts(fact.where("false"), "fk", dimension, "id").first()) == (0, 0)
    assert rows_of(orphan_rows(fact, "fk", dimension, "id")) == [(9, 2)]


def test_cleanse_and_reject(spark):
    rows = spark.createDataFrame(
        [(1, " ab ", "A@B.C"), (1, "ab", "x@y.z"), (2, None, "q@r.s"), (2, "ok", "q@r.s"), (3, "bad!", None)],
        "id int, name string, mail string",
    )
    spec = TableSpec(
        "T", "s", "t", ("id",), not_null_columns=("name",), lower_case_columns=("mail",),
        transformations=(RuleSpec("name", "regex", "[A-Z]+$", "Name must be letters"),),
    )
    loaded = loads.load_staging(rows, spec)
    assert rows_of(loaded) == sorted(
        [
            (1, "AB", "a@b.c", 1, None),
            (1, "AB", "x@y.z", 0, "Duplicate business key"),
            (2, "OK", "q@r.s", 1, None),
            (2, None, "q@r.s", 0, "name is missing; Duplicate business key"),
            (3, "BAD!", None, 0, "Name must be letters"),
        ],
        key=repr,
    )


def test_type1_dimension_overwrites(spark):
    first = spark.createDataFrame([(10, "a"), (20, "b"), (20, "c")], "id int, v string")
    current = loads.load_scd1(None, first, ["id"], "sk")
    assert rows_of(current) == [(1, 10, "a"), (2, 20, "b")]
    later = spark.createDataFrame([(20, None), (30, "d"), (5, "e")], "id int, v string")
    assert rows_of(loads.load_scd1(current, later, ["id"], "sk")) == [(1, 10, "a"), (2, 20, None), (3, 5, "e"), (4, 30, "d")]


def test_type2_dimension_keeps_history(spark):
    days = [datetime(2024, m, 1) for m in (1, 2, 3)]
    versions = [[(1, "a"), (2, "b")], [(1, "A"), (2, "b"), (3, "c")], [(1, "A"), (2, "z")]]
    current = None
    for day, rows in zip(days, versions):
        current = loads.load_scd2(current, spark.createDataFrame(rows, "id int, v string"), ["id"], "sk", day)
    assert rows_of(current) == [
        (1, 1, "a", 0, days[0], days[1]),
        (2, 2, "b", 0, days[0], days[2]),
        (3, 1, "A", 1, days[1], None),
        (4, 3, "c", 1, days[1], None),
        (5, 2, "z", 1, days[2], None),
    ]


def test_table_store(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 as `double value`").write.parquet(f"{tmp_path}/numbers")
    store = TableStore(spark, {"files": {"format": "parquet", "path": str(tmp_path)}})
    assert store.columns("files", "dbo.numbers") == ["id", "double value"]
    assert rows_of(store.read_table("files", "numbers", ["double value"], "id > 2")) == [(6,), (8,)]
    assert store.row_count("files", "numbers", "id > 2").first()["cnt"] == 2
    assert rows_of(store.read_query("files", "select sum(id) as s from {numbers} where id < 3")) == [(3,)]
    calls = []
    store.register("mem", "t", lambda: calls.append(1) or spark.range(1))
    assert store.table("mem", "t").count() + store.table("mem", "t").count() == 2 and len(calls) == 1
    with pytest.raises(ValueError, match="Unknown database 'nope'"):
        store.table("nope", "t")


def test_catalog_tables(spark):
    spark.range(3).createOrReplaceTempView("catalog_numbers")
    spark.sql("create database if not exists stored")
    spark.sql("create or replace temp view other as select 1")
    try:
        spark.range(4).write.mode("overwrite").saveAsTable("stored.numbers")
        store = TableStore(spark, {"db": {"catalog": "stored"}})
        assert store.read_table("db", "dbo.numbers", where="id < 2").count() == 2
    finally:
        spark.sql("drop database stored cascade")


def test_metadata(spark):
    df = spark.sql(
        "select 1 as i, 2L as l, cast(1.5 as decimal(18,2)) as d, cast(7 as decimal(9,0)) as w, 'abc' as s, "
        "date'2024-01-01' as dt, cast(null as string) as empty, 1.5D as f"
    )
    declared = {r["name"]: (r["data_type"], r["size"]) for r in column_metadata(df).collect()}
    assert declared == {
        "i": ("int", "10"), "l": ("bigint", "19"), "d": ("decimal", "18,2"), "w": ("decimal", "9"),
        "s": ("string", "MAX"), "dt": ("date", ""), "empty": ("string", "MAX"), "f": ("double", "53"),
    }
    observed = {r["name"]: (r["size"], r["nullable"], r["null_count"]) for r in column_profile(df).collect()}
    assert observed["s"] == ("3", "NO", 0) and observed["empty"] == ("0", "YES", 1)
    assert rows_of(fallback_metadata(spark, ["a", "b", "a"])) == [
        ("a", 1, "n/a", "n/a", "n/a"), ("b", 2, "n/a", "n/a", "n/a"),
    ]


def test_snapshot_and_outputs(spark, tmp_path):
    tables = {"dbo.parents": spark.range(3), "dbo.children": spark.range(5)}
    write_snapshot(tables, f"{tmp_path}/golden")
    live = f"{tmp_path}/live"
    write_snapshot({"dbo.parents": spark.range(99), "dbo.children": spark.range(99)}, live)
    restore_snapshot(spark, f"{tmp_path}/golden", list(tables), live)
    assert [df.count() for df in read_snapshot(spark, live, list(tables)).values()] == [3, 5]
    results = spark.sql("select 'L1' as layer, 1 as n union all select 'L2', 2")
    write_outputs({"results": results}, str(tmp_path), "json")
    assert (tmp_path / "results" / "layer=L1").is_dir()


def test_negative_rows_are_tagged(spark):
    from bank_data import negative_sources

    counts = [tuple(negative_count(df).first()) for df in negative_sources(spark).values()]
    assert counts == [(5, 1), (10, 3), (10, 2), (20, 2)]


def test_jdbc_options_of_a_table():
    location = {"format": "jdbc", "options": {"url": "jdbc:x"}, "tables": {"dbo.t": {
        "partitionColumn": "id", "lowerBound": 0, "upperBound": 100, "numPartitions": 8}}}
    assert TableStore.jdbc_options(location, "dbo.t")["numPartitions"] == 8
    assert TableStore.jdbc_options(location, "dbo.u") == {"url": "jdbc:x", "dbtable": "dbo.u"}
    with pytest.raises(ValueError, match="partitioned scan"):
        TableStore.jdbc_options({"options": {"partitionColumn": "id"}}, "t")


def test_outputs_with_nested_columns_as_csv(spark, tmp_path):
    df = spark.sql("select 1 as id, map('a', 2L) as metrics, array('x') as highlight")
    write_outputs({"results": df}, str(tmp_path), "csv")
    assert rows_of(spark.read.csv(str(tmp_path / "results"))) == [("1", '{"a":2}', '["x"]')]


def test_snapshots_keep_schemas_apart(spark, tmp_path):
    write_snapshot({"a.t": spark.range(3), "b.t": spark.range(7)}, str(tmp_path))
    found = read_snapshot(spark, str(tmp_path), ["a.t", "b.t"])
    assert [found[n].count() for n in ("a.t", "b.t")] == [3, 7]
    with pytest.raises(ValueError, match="same table"):
        write_snapshot({"t": spark.range(1), "dbo.t": spark.range(1)}, str(tmp_path))


def test_plain_text_of_floats(spark):
    cells = {"1e7": "10000000.0", "12345678.5": "12345678.5", "1e-3": "0.001", "2.5e-4": "0.00025", "-3e8": "-300000000.0", "1e16": "1.0E16"}
    for literal, text in cells.items():
        assert spark.sql(f"select {as_text(f'{literal}D', T.DoubleType())} as t").first()["t"] == text


def test_case_ids_are_unique():
    tables = {n: TableSpec(n, n, n, ("id",), ()) for n in ("Accounts", "Accruals", "Loans")}
    spec = PipelineSpec({"LayerOne": LayerSpec("LayerOne", "a", "b", tables), "LayerOther": LayerSpec("LayerOther", "a", "b", tables)})
    found = case_prefixes(spec)
    assert len(set(found.values())) == 6


def test_duplicate_message_lists_few_of_many_keys(spark):
    from tallymark.operators.duplicates import duplicate_message

    many = spark.range(5_000).selectExpr("if(id = 7, null, id) as a", "'x' as b", "explode(array(1, 2)) as copy")
    assert [tuple(r) for r in duplicate_message(many, ["a", "b"], 2).collect()] == [
        (5_000, 5_000, "5000 duplicate key group(s) on ['a', 'b']: (NULL, x) x2; (0, x) x2; and 4998 more")
    ]
    few = many.where("a in (3, 4)")
    assert duplicate_message(few, ["a"], 2).first()["message"] == "2 duplicate key group(s) on ['a']: (3) x2; (4) x2"
    assert tuple(duplicate_message(many.where("false"), ["a"]).first()) == (0, 0, "no duplicate keys")
