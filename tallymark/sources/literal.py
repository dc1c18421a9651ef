"""Small tables from the spec (labels, cases, skipped checks) as SQL literals.

Their size is that of the configuration. As a VALUES list they are part of the plan: no Python worker and no
partitions of their own, and joins with them need no hint.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallymark.functions.text import lit, quoted


def _literal(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return lit(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_literal(v) for v in value)})"
    return str(value).lower() if isinstance(value, bool) else repr(value)


def literal_rows(spark: SparkSession, columns: Mapping[str, str], rows: Iterable[Sequence[Any]]) -> DataFrame:
    """Rows of strings, numbers, NULLs and string lists; ``columns`` maps names to SQL types."""
    values = [f"({', '.join(_literal(v) for v in row)})" for row in rows]
    typed = ", ".join(f"cast(c{i} as {t}) as {quoted(name)}" for i, (name, t) in enumerate(columns.items()))
    listed = ", ".join(f"c{i}" for i in range(len(columns)))
    if not values:
        nulls = ", ".join("null" for _ in columns)
        return spark.sql(f"select {typed} from values ({nulls}) as t({listed}) where false")
    return spark.sql(f"select {typed} from values {', '.join(values)} as t({listed})")
