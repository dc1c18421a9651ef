"""Column metadata: what a schema declares and what the data shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymark.functions.text import lit, quoted
from tallymark.sources.literal import literal_rows

COLUMN_TYPES = {"name": "string", "ordinal": "int", "data_type": "string", "size": "string", "nullable": "string"}

# Decimal digits of the binary number types.
_PRECISION = {
    T.ByteType: "3",
    T.ShortType: "5",
    T.IntegerType: "10",
    T.LongType: "19",
    T.FloatType: "24",
    T.DoubleType: "53",
}


def type_name(dtype: T.DataType) -> str:
    return dtype.simpleString().split("(")[0].split("<")[0]


def declared_size(dtype: T.DataType) -> str:
    """``MAX`` or length for text, ``p`` or ``p,s`` for numbers, empty otherwise."""
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return str(dtype.length)
    if isinstance(dtype, T.StringType):
        return "MAX"
    if isinstance(dtype, T.DecimalType):
        return f"{dtype.precision},{dtype.scale}" if dtype.scale else str(dtype.precision)
    return _PRECISION.get(type(dtype), "")


def _declared(df: DataFrame) -> list[tuple[str, int, str, str, str]]:
    return [
        (f.name, i, type_name(f.dataType), declared_size(f.dataType), "YES" if f.nullable else "NO")
        for i, f in enumerate(df.schema.fields, start=1)
    ]


def column_metadata(df: DataFrame) -> DataFrame:
    """One row for each column from the schema alone; no data is read."""
    return literal_rows(df.sparkSession, COLUMN_TYPES, _declared(df))


def fallback_metadata(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """Metadata of a table that cannot be read: the configured columns, everything else not available."""
    rows = [(c, i, "n/a", "n/a", "n/a") for i, c in enumerate(dict.fromkeys(columns), start=1)]
    return literal_rows(spark, COLUMN_TYPES, rows)


def column_profile(df: DataFrame) -> DataFrame:
    """Column metadata as the data shows it, in one pass over the table.

    Files and most catalogs declare every column nullable and text without a length. The observed size of a text is
    its longest value, and a column is nullable when it holds a NULL. ``null_count`` counts them.
    """
    fields = list(zip(df.schema.fields, _declared(df)))
    measures, rows = [], []
    for i, (f, (name, ordinal, dtype, size, _)) in enumerate(fields):
        measures.append(f"count_if({quoted(name)} is null) as n{i}")
        observed = lit(size)
        if isinstance(f.dataType, T.StringType):
            measures.append(f"max(char_length({quoted(name)})) as l{i}")
            observed = f"cast(coalesce(l{i}, 0) as string)"
        rows.append(
            f"named_struct('name', {lit(name)}, 'ordinal', {ordinal}, 'data_type', {lit(dtype)}, 'size', {observed}, "
            f"'nullable', if(n{i} > 0, 'YES', 'NO'), 'null_count', n{i})"
        )
    return df.selectExpr(*measures).selectExpr(f"inline(array({', '.join(rows)}))")
