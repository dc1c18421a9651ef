"""Baselines: write tables to a snapshot, restore them from it, persist run outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymark.functions.text import lit, quoted
from tallymark.operators.foreign_keys import orphan_rows
from tallymark.spec import table_path


def _folder(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table_path(table)}"


def write_snapshot(tables: Mapping[str, DataFrame], root: str) -> None:
    """Write each table as a parquet folder (schema, then name) under ``root``, in the given (parents first) order."""
    if len({table_path(name) for name in tables}) < len(tables):
        raise ValueError(f"two names mean the same table: {sorted(tables)}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(_folder(root, name))


def read_snapshot(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(_folder(root, name)) for name in names}


def restore_snapshot(spark: SparkSession, root: str, names: Sequence[str], destination: str) -> dict[str, DataFrame]:
    """Replace the tables at ``destination`` by the snapshot, parents first.

    An overwrite clears and fills a table in one step, so no separate child-to-parent deletion is needed.
    """
    write_snapshot(read_snapshot(spark, root, names), destination)
    return read_snapshot(spark, destination, names)


@dataclass(frozen=True)
class Link:
    """``column`` of the table ``child`` refers to ``parent_column`` of ``parent``; NULL refers to nothing."""

    child: str
    column: str
    parent: str
    parent_column: str


class RestoreRefused(ValueError):
    """The snapshot would leave orphans; ``orphans`` lists them: child, column, key (as text), n_rows."""

    def __init__(self, message: str, orphans: DataFrame) -> None:
        super().__init__(message)
        self.orphans = orphans


def restore_order(names: Sequence[str], links: Sequence[Link]) -> list[str]:
    """Parents before their children; otherwise the given order. A table that refers to itself is no obstacle."""
    parents = {n: {k.parent for k in links if k.child == n and k.parent in names and k.parent != n} for n in names}
    try:
        return list(TopologicalSorter(parents).static_order())
    except CycleError as problem:
        raise ValueError(f"tables refer to each other in a circle: {problem.args[1]}") from None


def orphans_of(tables: Mapping[str, DataFrame], links: Sequence[Link]) -> DataFrame:
    """Keys that no parent row has, of every link: child, column, key, n_rows."""
    parts = [
        orphan_rows(tables[k.child], k.column, tables[k.parent], k.parent_column).selectExpr(
            f"{lit(k.child)} as child", f"{lit(k.column)} as column", f"cast({quoted(k.column)} as string) as key", "n_rows"
        )
        for k in links
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def restore_linked(
    spark: SparkSession, root: str, names: Sequence[str], destination: str, links: Sequence[Link]
) -> dict[str, DataFrame]:
    """Replace linked tables by their snapshot, so that at no time a row refers to an absent parent.

    A snapshot with orphans is refused before anything is touched. Then the tables are emptied from children to parents and filled from
    parents to children. A restore that breaks can be run again from the start. Tables are returned in the order of filling.
    """
    kept = read_snapshot(spark, root, names)
    unknown = sorted({n for k in links for n in (k.child, k.parent)} - set(names))
    if unknown:
        raise ValueError(f"links name tables that are not restored: {unknown}")
    order = restore_order(names, links)
    if links:
        orphans = orphans_of(kept, links)
        broken = sorted(r[0] for r in orphans.select("child").distinct().collect())
        if broken:
            raise RestoreRefused(f"the snapshot has orphans in {broken}", orphans)
    for name in reversed(order):
        kept[name].limit(0).write.mode("overwrite").parquet(_folder(destination, name))
    write_snapshot({name: kept[name] for name in order}, destination)
    return read_snapshot(spark, destination, order)


def write_outputs(outputs: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Persist results, summaries and failure records, partitioned by layer where there is one.

    Formats without nested columns (csv) get arrays and maps as JSON text.
    """
    for name, df in outputs.items():
        if fmt == "csv":
            nested = (T.ArrayType, T.MapType, T.StructType)
            df = df.selectExpr(
                *[
                    f"to_json({quoted(f.name)}) as {quoted(f.name)}" if isinstance(f.dataType, nested) else quoted(f.name)
                    for f in df.schema.fields
                ]
            )
        writer = df.write.mode("overwrite").format(fmt)
        if "layer" in df.columns:
            writer = writer.partitionBy("layer")
        writer.save(f"{root.rstrip('/')}/{name}")
