"""Test data with deliberate defects."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tallymark.functions.text import aliased, case, concat, joined, lit, quoted
from tallymark.operators.sampling import hash_place, hash_thresholds

NEGATIVE = "NEGATIVE: "


@dataclass(frozen=True)
class Defect:
    """Where ``predicate`` holds, ``column`` becomes ``expression`` and the row is tagged with ``note``."""

    predicate: str
    column: str
    expression: str
    note: str
    negative: bool = True


def inject_defects(rows: DataFrame, defects: Sequence[Defect]) -> DataFrame:
    """Apply the defects to a table of any size; ``_note`` tells what was done to a row (NULL: nothing).

    When several defects of one column hold for a row, the last one decides the value.
    """
    changed = {}
    for f in rows.schema.fields:
        choices = [
            (d.predicate, f"cast({d.expression} as {f.dataType.simpleString()})")
            for d in reversed(defects)
            if d.column == f.name
        ]
        changed[f.name] = case(choices, quoted(f.name))
    negative = [case([(d.predicate, lit(d.note))]) for d in defects if d.negative]
    harmless = [case([(d.predicate, lit(d.note))]) for d in defects if not d.negative]
    mark = f"if({joined('; ', negative)} != '', {lit(NEGATIVE)}, '')"
    note = f"nullif({concat(mark, joined('; ', [*negative, *harmless]))}, '')"
    return rows.selectExpr(*aliased({**changed, "_note": note}))


def inject_exactly(rows: DataFrame, keys: Sequence[str], counts: Sequence[tuple[Defect, int]], seed: int = 0) -> DataFrame:
    """Each defect in exactly so many rows, no row with two of them, whatever the size of the table.

    The rows are picked by a hash of their keys; the defects' own predicates narrow nothing (see :func:`inject_defects` for those).
    A table with fewer rows than defects gets those that come first.
    """
    ends = [sum(n for _, n in counts[: i + 1]) for i in range(len(counts))]
    place, limits = hash_place(keys, seed), [0, *hash_thresholds(rows, keys, ends, seed)]
    placed = [
        replace(d, predicate=f"{place} >= {low} and {place} < {high}")
        for (d, _), low, high in zip(counts, limits, limits[1:])
    ]
    return inject_defects(rows, placed)


def negative_count(rows: DataFrame) -> DataFrame:
    """One row: all rows and those tagged negative."""
    return rows.selectExpr("count(1) as total", f"count_if(startswith(_note, {lit(NEGATIVE.strip())})) as negative")
