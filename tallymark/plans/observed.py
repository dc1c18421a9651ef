"""What a check reads: every table it takes from the store is counted while the check runs."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallymark.sources.tables import TableStore

WAIT_SECONDS = 10
"""How long to wait for a count that may not come: adaptive execution can drop a branch that turned out to need no rows."""


class ObservedStore(TableStore):
    """A store over the tables of another one that observes each read. The counts are taken from the job itself; nothing is read twice."""

    def __init__(self, inner: TableStore) -> None:
        self.__dict__.update(inner.__dict__)
        self._reads: list[Observation] = []

    def read_table(
        self, logical_db: str, table: str, columns: Sequence[str] | None = None, where: str | None = None
    ) -> DataFrame:
        seen = Observation()
        self._reads.append(seen)
        return super().read_table(logical_db, table, columns, where).observe(seen, F.count(F.lit(1)).alias("n"))

    def rows_read(self) -> int | None:
        """All rows read by the job that has run; None if one of its reads has left no count."""
        counts: list[int] = []

        def gather() -> None:
            counts.extend(seen.get["n"] for seen in self._reads)

        waiting = threading.Thread(target=gather, daemon=True)
        waiting.start()
        waiting.join(WAIT_SECONDS)
        return sum(counts) if len(counts) == len(self._reads) else None
