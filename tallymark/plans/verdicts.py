"""Verdicts without counts: is there any problem at all?

A check asks for problem rows, cheapest kind first, and takes one. Spark then runs the first partitions only and more of them while nothing
is found, so a check that fails ends early; only a check that passes reads everything. Checks on numbers of rows are counted as usual.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from tallymark.functions.rules import broken
from tallymark.functions.text import quoted
from tallymark.operators.compare import BOTH, SOURCE_ONLY
from tallymark.operators.duplicates import duplicate_keys
from tallymark.operators.foreign_keys import foreign_key_counts
from tallymark.plans import checks
from tallymark.plans.checks import CheckContext, check_results


def _any(conditions: Sequence[str]) -> str:
    return " or ".join(f"coalesce({c}, false)" for c in conditions) or "false"


def _null_rows(ctx: CheckContext, columns: Sequence[str]) -> DataFrame:
    return ctx.side("target", columns).where(_any([f"{quoted(c)} is null" for c in columns]))


def problem_rows(ctx: CheckContext, check: str) -> Iterator[DataFrame] | None:
    """Tables of which any row fails the check; None for a check that needs numbers."""
    table = ctx.table
    if check == checks.NULL:
        return (_null_rows(ctx, table.not_null_columns) for _ in range(1) if table.not_null_columns)
    if check == checks.TRANSFORMATION:
        schema = ctx.store.table(ctx.layer.target_db, table.target_table).schema
        return (ctx.side("target").where(_any([broken(r, schema) for r in table.transformations])) for _ in range(1) if table.transformations)
    if check == checks.DUPLICATE:
        return (duplicate_keys(ctx.side("target", table.key), table.key) for _ in range(1))
    if check == checks.CONSTRAINT:
        kinds = (lambda: _null_rows(ctx, table.key), lambda: duplicate_keys(ctx.side("target", table.key), table.key))
        return (kind() for kind in kinds)
    if check in checks.COMPARISONS:
        judged = f"n_diffs > 0 or state != '{BOTH}' or is_duplicate"
        if check == checks.INTEGRITY and ctx.layer.tolerate_missing_in_target:
            judged = f"n_diffs > 0 or state not in ('{BOTH}', '{SOURCE_ONLY}') or is_duplicate"
        return (ctx.comparison(check).issues.where(judged) for _ in range(1))
    if check == checks.FOREIGN_KEY:
        def found(fk):
            read = ctx.store.read_table
            fact = read(ctx.layer.target_db, table.target_table, [fk.column])
            known = read(ctx.layer.target_db, fk.ref_table, [fk.ref_column])
            if not fk.allow_null:
                yield fact.where(f"{quoted(fk.column)} is null")
            counts = foreign_key_counts(fact, fk.column, known, fk.ref_column, fk.null_aware)
            yield counts.where("orphans > 0")

        return (frame for fk in table.foreign_keys for frame in found(fk))
    return None


def verdict(ctx: CheckContext, check: str) -> str:
    """PASS or FAIL, as the check itself would say."""
    frames = problem_rows(ctx, check)
    if frames is None:
        return check_results(ctx, [check]).first()["status"]
    return "FAIL" if any(not frame.isEmpty() for frame in frames) else "PASS"
