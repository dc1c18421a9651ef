"""Rows whose business key occurs more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import all_of, case, concat, filled, joined, listed, lit, names, python_list, quoted
from tallymark.operators.hotkeys import hot_keys, key_counts
from tallymark.operators.pairing import key_names, normalised_keys
from tallymark.session import HOT_KEY_ROWS


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key groups with more than one row, with their count. Raw keys; NULL keys form a group, as in SQL."""
    return key_counts(rows, keys, "cnt").where("cnt > 1")


def duplicate_message(rows: DataFrame, keys: Sequence[str], first: int = 5) -> DataFrame:
    """One row: ``duplicate_groups``, ``surplus_rows`` (beyond one of each group) and a ``message`` with the ``first`` keys in ascending order.

    NULL comes first. Every task keeps at most ``first`` keys, however many are duplicated; the others are counted. Rows without
    duplicates, or no rows at all, give zeros.
    """
    repeated = duplicate_keys(rows, keys)
    shown = concat(
        lit("("), joined(", ", [f"coalesce(cast({quoted(k)} as string), 'NULL')" for k in keys]), lit(") x"), "cast(cnt as string)"
    )
    counts = repeated.selectExpr("count(1) as n", "coalesce(sum(cnt - 1), 0L) as surplus", "cast(null as array<string>) as texts")
    entries = repeated.orderBy(*names(keys)).limit(first).selectExpr(f"struct({listed(keys)}) as at", f"{shown} as text")
    sample = entries.selectExpr("0L as n", "0L as surplus", "transform(sort_array(collect_list(struct(at, text))), x -> x.text) as texts")
    both = counts.unionByName(sample).selectExpr("sum(n) as n", "sum(surplus) as surplus", "max(texts) as texts")
    more = case([(f"n > {int(first)}", filled("; and {more} more", more=f"(n - {int(first)})"))], "''")
    found = concat(filled(f"{{n}} duplicate key group(s) on {python_list(keys)}: ", n="n"), "array_join(texts, '; ')", more)
    return both.selectExpr(
        "n as duplicate_groups", "surplus as surplus_rows", f"if(n = 0, 'no duplicate keys', {found}) as message"
    )


def duplicate_rows(
    rows: DataFrame, keys: Sequence[str], other: DataFrame | None = None, hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Full rows of every duplicated key, with ``_copies``. Keys are normalised; rows with a NULL key do not count.

    Rows of hot keys are taken in a map-side join with the short list of those keys and are never shuffled; the
    remaining duplicated keys hold at most ``hot_rows`` rows each and go through an ordinary join.
    """
    normal = key_names(keys)
    keyed = rows.selectExpr("*", *normalised_keys(rows, keys, other))
    keyed = keyed.where(all_of(f"{quoted(n)} is not null" for n in normal))
    repeated = key_counts(keyed, normal, "_copies").where("_copies > 1")
    hot = F.broadcast(repeated.where(f"_copies > {hot_rows}"))
    cold = repeated.where(f"_copies <= {hot_rows}")

    output = [*names(rows.schema.names), "_copies"]
    from_hot = keyed.join(hot, normal).select(*output)
    from_cold = keyed.join(hot, normal, "left_anti").join(cold, normal).select(*output)
    return from_hot.unionByName(from_cold)


def mark_first(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (), hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Add ``_first``: true on exactly one row of each key, the first in the order of the given and all columns.

    Ordinary keys are ranked in one window. A hot key is ranked in two steps: first inside the rows that came from
    the same input partition, then among those local winners, of which there is one for each partition; every other
    row keeps a window group of its own partition, so no task receives the whole key.
    """
    columns = rows.schema.names
    by, sort = listed(keys), listed(dict.fromkeys([*order, *columns]))
    hot = F.broadcast(hot_keys(rows, keys, hot_rows)).alias("h")
    at_hot = F.expr(all_of(f"r.{quoted(k)} <=> h.{quoted(k)}" for k in keys))

    cold = rows.alias("r").join(hot, at_hot, "left_anti")
    cold = cold.selectExpr("*", f"row_number() over (partition by {by} order by {sort}) = 1 as _first")

    parts = rows.alias("r").join(hot, at_hot, "left_semi").selectExpr("*", "spark_partition_id() as _part")
    local = parts.selectExpr("*", f"row_number() over (partition by {by}, _part order by {sort}) = 1 as _local")
    grouped = local.selectExpr("*", "if(_local, -1, _part) as _group")
    ranked = grouped.selectExpr(
        "*", f"_local and row_number() over (partition by {by}, _group order by {sort}, _part) = 1 as _first"
    )
    return cold.unionByName(ranked.select(*names(columns), "_first"))
