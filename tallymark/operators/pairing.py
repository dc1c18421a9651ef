"""Bring the rows of two tables together by business key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.normalize import key_value
from tallymark.functions.text import listed, names, quoted

KEY_PREFIX = "__key_"


def key_names(keys: Sequence[str]) -> list[str]:
    return [f"{KEY_PREFIX}{k}" for k in keys]


def normalised_keys(rows: DataFrame, keys: Sequence[str], other: DataFrame | None = None) -> list[str]:
    """Select list of the normalised keys, of one type for both tables."""
    mine, theirs = rows.schema, (rows if other is None else other).schema
    return [
        f"{key_value(quoted(k), mine[k].dataType, theirs[k].dataType)} as {quoted(KEY_PREFIX + k)}" for k in keys
    ]


def pair_by_key(
    source: DataFrame, target: DataFrame, keys: Sequence[str], order_columns: Sequence[str] = ()
) -> DataFrame:
    """One row for each normalised key of either side: ``n_source, n_target, source_row, target_row``.

    ``source_row`` and ``target_row`` are the first rows of the key, in the order of the compared columns, so the
    choice is repeatable. Both sides go through *one* shuffle as a tagged union; the partial aggregate keeps a
    single row for each key and task before it, so a key with a third of all rows costs no more than any other.
    A NULL key is a group of its own, as in a null-safe full outer join.
    """
    tagged = []
    for side, rows, other in (("source", source, target), ("target", target, source)):
        present = rows.schema.names
        ordered = dict.fromkeys([*[c for c in order_columns if c in present], *keys, *present])
        row = f"struct({listed(ordered)}) as {side}_row"
        tagged.append(rows.selectExpr(*normalised_keys(rows, keys, other), row))
    both = tagged[0].unionByName(tagged[1], allowMissingColumns=True)
    return both.groupBy(*names(key_names(keys))).agg(
        F.expr("count(source_row) as n_source"),
        F.expr("count(target_row) as n_target"),
        F.expr("min(source_row) as source_row"),
        F.expr("min(target_row) as target_row"),
    )
