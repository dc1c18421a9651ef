"""Foreign keys of a fact against a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import quoted


def foreign_key_counts(
    fact: DataFrame, column: str, dimension: DataFrame, ref_column: str, null_aware: bool = False
) -> DataFrame:
    """One row ``orphans, nulls``: fact rows whose key is in no dimension row, and fact rows without a key.

    Both sides are reduced to their distinct keys before the only shuffle, so neither a hot foreign key nor a
    missing default value concentrates rows, and no side is broadcast. ``null_aware`` follows SQL ``NOT IN``: one
    NULL in the referenced column means that no orphan is reported.
    """
    used = fact.selectExpr(f"{quoted(column)} as key", "1L as uses", "0 as defines")
    known = dimension.selectExpr(f"{quoted(ref_column)} as key", "0L as uses", "1 as defines")
    per_key = (
        used.unionByName(known)
        .groupBy("key")
        .agg(F.expr("sum(uses) as uses"), F.expr("max(defines) as defined"))
    )
    orphans = "coalesce(sum(if(key is not null and defined = 0, uses, 0L)), 0L)"
    if null_aware:
        orphans = f"if(count_if(key is null and defined = 1) > 0, 0L, {orphans})"
    return per_key.selectExpr(f"{orphans} as orphans", "coalesce(sum(if(key is null, uses, 0L)), 0L) as nulls")


def orphan_rows(fact: DataFrame, column: str, dimension: DataFrame, ref_column: str) -> DataFrame:
    """Distinct orphan keys with the number of fact rows that use them."""
    key = quoted(column)
    used = fact.where(f"{key} is not null").groupBy(key).agg(F.expr("count(1) as n_rows"))
    known = dimension.selectExpr(f"{quoted(ref_column)} as _known").distinct()
    return used.join(known, F.expr(f"{key} = _known"), "left_anti")
