"""Normalisation, equality and rules, value by value."""

from __future__ import annotations

import pytest

from pyspark.sql import types as T

from tallymark.functions.normalize import BLANK_TEXT, folded, kind_of, key_value, normalised, values_equal
from tallymark.functions.rules import broken, register_rule, rule_names
from tallymark.spec import RuleSpec


def typed(spark, left: str, right: str):
    return spark.sql(f"select {left} as a, {right} as b")


def equal(spark, left: str, right: str, **options) -> bool:
    df = typed(spark, left, right)
    text = values_equal("a", df.schema["a"].dataType, "b", df.schema["b"].dataType, **options)
    value = df.selectExpr(text + " as e").first()["e"]
    assert value is not None
    return value


@pytest.mark.parametrize(
    ("left", "right", "same"),
    [
        ("cast(null as string)", "cast(null as string)", True),
        ("''", "cast(null as string)", True),
        ("'  '", "''", True),
        ("'a'", "cast(null as string)", False),
        ("'a '", "'\ta'", True),
        ("'a'", "'A'", False),
        ("10", "10.00", True),
        ("10", "cast(10 as double)", True),
        ("true", "1", True),
        ("cast(1.0 as double)", "cast(1.0 as double) + 5e-10D", True),
        ("cast(1.0 as double)", "cast(1.0 as double) + 2e-9D", False),
        ("cast('NaN' as double)", "cast(null as double)", True),
        ("cast('Infinity' as double)", "cast('Infinity' as double)", False),
        ("9007199254740993L", "9007199254740992L", False),
        ("1", "'1'", False),
        ("cast(null as int)", "cast(null as string)", True),
        ("cast(null as int)", "''", True),
        ("date'2023-01-11'", "date'2023-01-11'", True),
        ("date'2023-01-11'", "'2023-01-11'", True),
        ("timestamp'2023-01-11 00:00:00'", "date'2023-01-11'", False),
        ("timestamp'2023-01-11 10:00:00'", "'2023-01-11 10:00:00'", True),
        ("timestamp'2023-01-11 10:00:00.5'", "'2023-01-11 10:00:00.500000'", True),
        ("timestamp'2023-01-11 10:00:00'", "timestamp_ntz'2023-01-11 10:00:00'", True),
    ],
)
def test_values_equal(spark, left, right, same):
    assert equal(spark, left, right) is same


def test_case_insensitive_and_exact_decimals(spark):
    assert equal(spark, "'Credit '", "'CREDIT'", case_insensitive=True)
    first, second = "cast(1.0000000001 as decimal(18,10))", "cast(1.0000000002 as decimal(18,10))"
    assert equal(spark, first, second)
    assert not equal(spark, first, second, exact_decimals=True)


def test_strip_removes_every_unicode_blank(spark):
    df = spark.createDataFrame([(f"{BLANK_TEXT}x y{BLANK_TEXT}",)], "v string")
    assert df.selectExpr(normalised("v", T.StringType()) + " as n").first()["n"] == "x y"
    assert BLANK_TEXT.strip() == "" and len(BLANK_TEXT) == 29


def test_key_value_types(spark):
    assert kind_of(T.DecimalType(10, 0)) == "integer" and kind_of(T.DecimalType(10, 2)) == "number"
    df = spark.sql("select 7 as i, '7' as s, cast(7 as decimal(20,0)) as d, cast(null as int) as n")
    keys = {
        "int_int": key_value("i", T.IntegerType(), T.LongType()),
        "int_text": key_value("i", T.IntegerType(), T.StringType()),
        "text_int": key_value("s", T.StringType(), T.IntegerType()),
        "null_text": key_value("n", T.IntegerType(), T.StringType()),
    }
    row = df.selectExpr(*[f"{v} as {k}" for k, v in keys.items()]).first()
    assert row["int_int"] == 7
    assert row["int_text"] != row["text_int"]
    assert row["null_text"] is None


def breaks(spark, rule: RuleSpec, values: list, dtype: str = "string") -> list:
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    found = {r["i"] for r in df.where(broken(rule, df.schema)).collect()}
    return [v for i, v in enumerate(values) if i in found]


def test_rules(spark):
    assert breaks(spark, RuleSpec("v", "not_null"), ["a", "", None]) == [None]
    assert breaks(spark, RuleSpec("v", "no_whitespace"), ["a", " a", "a ", "a b", None]) == [" a", "a "]
    assert breaks(spark, RuleSpec("v", "length_equals", 3), ["USD", "US", "\U0001d11eab", None]) == ["US"]
    assert breaks(spark, RuleSpec("v", "in_set", ["A", 1]), ["A", "a", "1", "2", None]) == ["a", "2"]
    assert breaks(spark, RuleSpec("v", "min_value", 0), ["-1", "0", "x", None]) == ["-1", "x"]
    assert breaks(spark, RuleSpec("v", "min_value", 0.5), [0.25, 0.5, float("nan"), None], "double") == [0.25]
    # anchored at the start only, and quotes or backslashes in a pattern are safe
    assert breaks(spark, RuleSpec("v", "regex", r"[1-5]-|it's\d"), ["1-x", "x1-", "it's7", "", None]) == ["x1-", ""]


def test_rule_registry(spark):
    with pytest.raises(ValueError, match="Unknown transformation rule 'nope'"):
        broken(RuleSpec("v", "nope"), T.StructType([T.StructField("v", T.StringType())]))
    register_rule("starts_with", lambda value, dtype, setting: f"not startswith({value}, '{setting}')")
    assert "starts_with" in rule_names()
    assert breaks(spark, RuleSpec("v", "starts_with", "a"), ["ab", "ba", None]) == ["ba"]


def test_equal_texts_are_not_folded():
    text = T.StringType()
    assert values_equal("a", text, "b", text, True).startswith("(a <=> b or ")
    assert values_equal("a", text, "b", text).startswith("(a <=> b or ")
    assert not values_equal("a", T.DoubleType(), "b", T.DoubleType()).startswith("(a <=> b")


def test_texts_equal_in_lower_case_are_equal_when_folded(spark):
    letters = spark.range(1, 0x110000).where("id not between 55296 and 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c")
    assert letters.selectExpr("count(distinct c) as n").first()["n"] == 0x110000 - 1 - 2048
    assert letters.where(f"lower(c) != c and not {folded('c')} <=> {folded('lower(c)')}").collect() == []
