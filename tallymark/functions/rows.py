"""Display text of whole rows, as SQL expressions over a row struct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

from tallymark.functions.normalize import TEXT, as_text, kind_of, shown
from tallymark.functions.text import concat, field, joined, lit


def key_text(keys: Sequence[str], schema: T.StructType, row: str) -> str:
    """``k1=v1, k2=v2`` of a row struct."""
    return joined(", ", [concat(lit(f"{k}="), shown(field(row, k), schema[k].dataType)) for k in keys])


def row_text(keys: Sequence[str], schema: T.StructType, row: str) -> str:
    """``k=v | a=v | ...`` of a row struct, key columns first, text values in quotes."""
    def cell(name: str) -> str:
        dtype = schema[name].dataType
        text = as_text(field(row, name), dtype)
        if kind_of(dtype) == TEXT:
            text = concat("'\\''", text, "'\\''")
        return concat(lit(f"{name}="), f"coalesce({text}, 'None')")

    return joined(" | ", [cell(name) for name in [*keys, *[n for n in schema.names if n not in keys]]])
