"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROWS = 1_000_000
"""Lists of ids up to this many rows (about 50 MB in an executor) are broadcast; longer ones are joined by a shuffle."""

BROADCAST_BYTES = 32 << 20
"""Tables measured to hold at most this many bytes are broadcast."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark narrow rows for a broadcast join if they are counted to be few; else leave the join to a shuffle."""
    counted = df.count() if rows is None else rows
    return df.hint("broadcast") if counted <= limit else df.hint("merge")


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until it is no column of a table (names of columns do not depend on case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows: the lengths of texts and binaries, and 16 for every value."""
    long = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    each = " + ".join([str(16 * len(df.columns)), *(f"coalesce(octet_length(`{c}`), 0)" for c in long)])
    return df.selectExpr(f"coalesce(sum(cast({each} as bigint)), 0)").first()[0]


def broadcast_if_light(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a flat table for a broadcast join if it is measured to be light; else leave the join to a shuffle."""
    return df.hint("broadcast") if measured_bytes(df) <= limit else df.hint("merge")


def batches_of(values: list, sizes: list[int], most: int) -> Iterator[list]:
    """Consecutive values whose sizes add up to ``most`` at most; a larger value is a batch of its own."""
    held, total = [], 0
    for value, size in zip(values, sizes, strict=True):
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(value)
        total += size
    if held:
        yield held


def map_groups(df: DataFrame, keys: list[str], columns: list[str], work: Callable, schema: str) -> DataFrame:
    """Like ``groupBy(keys).applyInPandas``, for very many small groups: ``work(key, columns)`` yields rows of ``schema``.

    The rows are dealt by key and sorted, and go through one Python stream for each partition, which holds one group at a time.
    ``columns`` arrive as one list for each column.
    """

    def stream(batches):
        import pandas as pd

        def rows():
            for frame in batches:
                yield from zip(*(frame[c].tolist() for c in [*keys, *columns]), strict=True)

        out, names = [], [part.split()[0] for part in schema.split(",")]
        for key, group in groupby(rows(), key=lambda row: row[: len(keys)]):
            found = list(zip(*group, strict=True))[len(keys) :]
            out.extend(work(key, found))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    dealt = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(stream, schema)


def with_column_from_texts(documents: DataFrame, work: Callable, fields: str) -> DataFrame:
    """All columns as they are, and more ones that ``work`` makes of a list of whole texts (null: None), in Arrow batches.

    ``fields`` is the schema of the new columns; ``work`` returns one list for each.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    schema = StructType([*documents.schema.fields, *added.fields])

    def stream(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = {f.name: [] for f in added.fields}
            for part in batches_of(texts, [len(t or "") for t in texts], 1 << 20):
                for name, values in zip(found, work(part), strict=True):
                    found[name].extend(values)
            columns = [pa.array(v, "string" if f.dataType.simpleString() == "string" else "float64") for f, v in zip(added.fields, found.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *found])

    return documents.mapInArrow(stream, schema)
