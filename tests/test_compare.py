"""Keyed comparison: hand-made cases, hot keys, screening, and random defects."""

from __future__ import annotations

import random

from conftest import rows_of

from tallymark import compare

SCHEMA = "k string, n int, v string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_all_kinds_of_differences(spark):
    source = frame(spark, [("a", 1, "x"), ("b", 2, "y "), ("c", 3, "z"), ("d", 4, None), ("d", 4, "w")])
    target = frame(spark, [("a ", 1, "X"), ("b", 5, "y"), ("d", 4, ""), ("e", 6, "q"), (None, 7, "q"), (None, 8, "r")])
    c = compare(source, target, ["k"], ["n", "v", "absent"])
    assert rows_of(c.diffs()) == [("a", "v", "x", "X"), ("b", "n", "2", "5")]
    assert rows_of(c.missing_in_target()) == [("c", 3, "z")]
    # the rows with a NULL key are one key, its first row shows; NULL keys are no duplicates
    assert rows_of(c.missing_in_source()) == [("e", 6, "q"), (None, 7, "q")]
    assert rows_of(c.duplicates().select("k", "v", "_copies", "_side")) == [
        ("d", "w", 2, "source"), ("d", None, 2, "source"),
    ]
    assert tuple(c.summary().first()) == (2, 2, 1, 2, 2, False)
    pairs = {tuple(r["diff_columns"]): (r["source_row"], r["target_row"]) for r in c.diff_pairs().collect()}
    assert tuple(pairs[("n",)][0]) == ("b", 2, "y ") and tuple(pairs[("n",)][1]) == ("b", 5, "y")
    insensitive = compare(source, target, ["k"], ["n", "v"], case_insensitive=True)
    assert rows_of(insensitive.diffs()) == [("b", "n", "2", "5")]


def test_keys_stay_case_sensitive_and_exact(spark):
    c = compare(frame(spark, [("a", 1, "x")]), frame(spark, [("A", 1, "x")]), ["k"], ["v"], case_insensitive=True)
    assert tuple(c.summary().first())[2:4] == (1, 1)
    big = "k bigint, v string"
    ids = [(2**53, "x"), (2**53 + 1, "x")]
    assert compare(frame(spark, ids, big), frame(spark, ids, big), ["k"], ["v"]).summary().first()["is_match"]


def test_key_types_may_differ(spark):
    numbers = frame(spark, [(1, "x"), (2, "y")], "k int, v string")
    decimals = spark.sql("select cast(k as decimal(10,2)) as k, v from values (1, 'x'), (2, 'y') as t(k, v)")
    assert compare(numbers, decimals, ["k"], ["v"]).summary().first()["is_match"]
    texts = frame(spark, [("1", "x"), ("2", "y")], "k string, v string")
    assert tuple(compare(numbers, texts, ["k"], ["v"]).summary().first())[:4] == (0, 0, 2, 2)


def test_empty_tables_match(spark):
    empty = frame(spark, [])
    assert compare(empty, empty, ["k"], ["n", "v"]).summary().first()["is_match"]


def test_first_row_of_a_key_is_repeatable(spark):
    source = frame(spark, [("a", 3, "x"), ("a", 1, "y"), ("a", 2, "z")]).repartition(3)
    target = frame(spark, [("a", 9, "y")])
    assert rows_of(compare(source, target, ["k"], ["n", "v"]).diffs()) == [("a", "n", "1", "9")]


def test_hot_keys_and_screening_change_nothing(spark):
    # a third of all rows has one key
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id) as k", "id % 7 as n", "cast(id % 5 as string) as v")
    source = rows.repartition(5)
    target = rows.where("k % 11 <> 1").selectExpr("k", "if(k % 13 = 2, n + 1, n) as n", "v")
    plain = compare(source, target, ["k"], ["n", "v"])
    hot = compare(source, target, ["k"], ["n", "v"], hot_rows=10)
    screened = compare(source, target, ["k"], ["n", "v"]).screen()
    refused = compare(source, target, ["k"], ["n", "v"]).screen(limit=0)
    expected = [rows_of(part) for part in (plain.summary(), plain.diffs(), plain.missing_in_target(), plain.duplicates())]
    assert len(expected[3]) == 2000
    for other in (hot, screened, refused):
        parts = (other.summary(), other.diffs(), other.missing_in_target(), other.duplicates())
        assert [rows_of(part) for part in parts] == expected
    assert screened._suspects is not None and refused._suspects is None


def test_screening_sees_moved_nulls(spark):
    source = spark.sql("select 1 as k, cast(null as string) as a, 'x' as b")
    target = spark.sql("select 1 as k, 'x' as a, cast(null as string) as b")
    assert compare(source, target, ["k"], ["a", "b"]).screen().summary().first()["diffs"] == 2


def test_random_defects_are_found_exactly(spark):
    rng = random.Random(7)
    rows = {i: [i, f"name {i}", i * 1.5, i % 4 == 0] for i in range(400)}
    changed = {i: list(r) for i, r in rows.items()}
    touched = rng.sample(range(400), 90)
    cells = 0
    for i in touched[:40]:
        for column in rng.sample([1, 2, 3], rng.randint(1, 3)):
            value = changed[i][column]
            changed[i][column] = (not value) if column == 3 else (value + 0.01 if column == 2 else value + "!")
            cells += 1
    for i in touched[40:60]:
        del changed[i]
    target = list(changed.values()) + [[1000 + i, "new", 0.0, False] for i in range(15)]
    copies = [changed[i] for i in touched[60:90]]
    schema = "k int, name string, amount double, flag boolean"
    c = compare(
        frame(spark, list(rows.values()), schema), frame(spark, target + copies, schema), ["k"], ["name", "amount", "flag"]
    ).keep()
    assert tuple(c.summary().first()) == (cells, 40, 20, 15, 60, False)
    assert c.diffs().count() == cells and c.duplicates().count() == 60
