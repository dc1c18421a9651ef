"""Consecutive numbers over an ordered table, without bringing it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import names, quoted
from tallymark.session import materialised

_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def number_rows(rows: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Add ``start + 1, start + 2, ...`` in the order of the given columns.

    A distributed sort gives each row its place inside its partition; the partition sizes, one row for each
    partition, are summed up and added. The sorted rows are written to shared storage, so that sizes and rows belong to the same
    partitioning even when a task is repeated.
    """
    sized = materialised(rows.orderBy(*names(order)).selectExpr("*", "monotonically_increasing_id() as __place"), "numbered")
    placed = sized.selectExpr("*", f"shiftright(__place, {_PART_BITS}) as __part")
    offsets = (
        placed.groupBy("__part")
        .count()
        .selectExpr(
            "__part",
            "coalesce(sum(count) over (order by __part rows between unbounded preceding and 1 preceding), 0) as __before",
        )
    )
    number = f"(__place & {(1 << _PART_BITS) - 1}L) + __before + {start + 1} as {quoted(name)}"
    return placed.join(F.broadcast(offsets), "__part").selectExpr(*names(rows.schema.names), number)
