"""Counting keys, and splitting those with very many rows from all the others.

Keys with more than ``hot_rows`` rows are found by a count with map-side combine. There can be at most
rows / hot_rows of them, so broadcasting that list is safe at any table size (see ``session.HOT_KEY_ROWS``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import names


def key_counts(rows: DataFrame, keys: Sequence[str], count_name: str) -> DataFrame:
    return rows.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias(count_name))


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """The keys with more than ``hot_rows`` rows, nothing else."""
    return key_counts(rows, keys, "_rows").where(f"_rows > {hot_rows}").select(*names(keys))
