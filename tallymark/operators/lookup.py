"""Left lookup of a large table against one with unique keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import names, quoted


def lookup(rows: DataFrame, key: str, reference: DataFrame, ref_key: str, take: Mapping[str, str]) -> DataFrame:
    """Add reference columns (``take``: new name -> reference column) to every row; NULL where nothing matches.

    ``reference`` must be unique by ``ref_key``. One left join, so that plans of many lookups grow in step with their number.
    Rows without a key carry a salt from their input partition and do not meet in one task. A key with very many
    rows has one reference row: the adaptive skew join splits its rows among tasks, and a small reference is
    broadcast by Spark itself.
    """
    k = quoted(key)
    values = [f"{quoted(c)} as {quoted(f'_v_{new}')}" for new, c in take.items()]
    reference = reference.selectExpr(f"{quoted(ref_key)} as _ref", *values, "0 as _ref_salt")
    salted = rows.selectExpr("*", f"if({k} is null, spark_partition_id() + 1, 0) as _salt")
    found = salted.join(reference, F.expr(f"{k} = _ref and _salt = _ref_salt"), "left")
    return found.selectExpr(
        *names(rows.schema.names), *[f"{quoted(f'_v_{new}')} as {quoted(new)}" for new in take]
    )
