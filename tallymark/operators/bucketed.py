"""Snapshots bucketed by key, and their comparison without a shuffle.

A table that is compared again and again pays for its partitioning once: the snapshot holds the normalised key as one text, is bucketed
by it, and each bucket is one file. Two snapshots with as many buckets meet bucket by bucket: each side is aggregated by key where
it lies, and a full outer join pairs the keys. No plan has an Exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.normalize import key_value
from tallymark.functions.text import concat, field, names, quoted
from tallymark.operators.compare import Comparison
from tallymark.operators.pairing import KEY_PREFIX

KEY = "__key"


def _key_text(rows: DataFrame, keys: Sequence[str]) -> str:
    """All keys as one text that is never NULL and that only equal keys share: each part with its length, ``-`` for NULL."""
    parts = []
    for k in keys:
        kind = rows.schema[k].dataType
        text = f"cast({key_value(quoted(k), kind, kind)} as string)"
        parts.append(f"coalesce(concat(cast(length({text}) as string), ':', {text}), '-')")
    return concat(*parts) if parts else "''"


def write_bucketed(rows: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Save ``rows`` as the catalog table ``table``, bucketed and sorted by their normalised key, in the warehouse or under ``path``.

    Choose ``buckets`` so that one bucket fits a task.
    """
    if KEY in rows.columns:
        raise ValueError(f"the column {KEY} is taken by snapshots")
    keyed = rows.selectExpr("*", f"{_key_text(rows, keys)} as {KEY}").repartition(buckets, KEY)
    writer = keyed.write.format("parquet").mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY)
    (writer.option("path", path) if path else writer).saveAsTable(table)


class BucketedComparison(Comparison):
    """A comparison whose sides hold the normalised key in ``__key``.

    One key is one task's work: a key with a great part of all rows makes its bucket as large. Tables with such keys are for
    :func:`tallymark.operators.compare.compare`, which reduces them before its shuffle.
    """

    def __init__(self, source: DataFrame, target: DataFrame, keys: Sequence[str], *options, **named) -> None:
        for k in keys:
            mine, theirs = source.schema[k].dataType, target.schema[k].dataType
            if mine != theirs:
                raise ValueError(f"key '{k}' is {mine.simpleString()} in one snapshot and {theirs.simpleString()} in the other")
        super().__init__(source, target, keys, *options, **named)
        self.columns = [c for c in self.columns if c != KEY]
        self.target_columns = [c for c in self.target_columns if c != KEY]

    def screen(self, *_: object) -> BucketedComparison:
        """Screening saves a shuffle of whole rows; here there is none."""
        return self

    def duplicates_on(self, side: str) -> DataFrame:
        return super().duplicates_on(side).drop(KEY)

    def _narrowed(self, columns: Sequence[str]) -> Comparison:
        return super()._narrowed([*columns, KEY])

    def _pair(self, source: DataFrame, target: DataFrame) -> DataFrame:
        def reduced(rows: DataFrame, side: str) -> DataFrame:
            present = [c for c in rows.schema.names if c != KEY]
            ordered = dict.fromkeys([*self.compare_columns, *self.keys, *present])
            row = f"struct({', '.join(names(ordered))})"
            return rows.groupBy(F.col(KEY).alias(f"{side}_key")).agg(
                F.expr("count(1)").alias(f"n_{side}"), F.expr(f"min({row})").alias(f"{side}_row")
            )

        both = reduced(source, "source").join(reduced(target, "target"), F.expr("source_key = target_key"), "full")
        keys = []
        for k in self.keys:
            kind = source.schema[k].dataType
            value = f"coalesce({field('source_row', k)}, {field('target_row', k)})"
            keys.append(f"{key_value(value, kind, kind)} as {quoted(KEY_PREFIX + k)}")
        rows = both.selectExpr(
            *keys, "coalesce(n_source, 0L) as n_source", "coalesce(n_target, 0L) as n_target", "source_row", "target_row"
        )
        return self._with_state(rows)


def compare_bucketed(
    spark: SparkSession, source: str, target: str, keys: Sequence[str], compare_columns: Sequence[str], **options
) -> BucketedComparison:
    """Compare two tables that :func:`write_bucketed` saved by the same keys with the same number of buckets. See ``compare`` for the options."""
    return BucketedComparison(spark.table(source), spark.table(target), keys, compare_columns, **options)
