"""Resolve logical table names to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from string import Formatter
from threading import RLock
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallymark.functions.text import names
from tallymark.spec import DEFAULT_SCHEMA, LayerSpec, TableSpec, split_table_name


class TableStore:
    """Tables of the logical databases.

    A database is a location: ``{"format": "parquet", "path": root}`` (also orc, csv, json, with ``options``; tables of other
    schemas than the default one lie in a folder of their schema),
    ``{"catalog": "db"}`` for catalog tables (``"schemas": True`` if it has schemas of its own), or ``{"format": "jdbc",
    "options": {...}, "tables": {name: {...}}}``, where ``tables`` holds the options of single tables, such as the partition column
    and its bounds. Tables registered as DataFrames take precedence. Nothing is read until an action runs, so filters and columns reach the scan.
    """

    def __init__(self, spark: SparkSession, databases: Mapping[str, Mapping[str, Any]] | None = None) -> None:
        self.spark = spark
        self.databases = dict(databases or {})
        self._registered: dict[tuple[str, str], DataFrame | Callable[[], DataFrame]] = {}
        self._building = RLock()  # tables of several jobs are planned at once, each is built once

    def register(self, logical_db: str, table: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """Register a DataFrame, or a function that builds it when the table is asked for the first time."""
        self._registered[logical_db, table] = df

    def _location(self, logical_db: str) -> Mapping[str, Any]:
        if logical_db not in self.databases:
            raise ValueError(f"Unknown database '{logical_db}'. Known databases: {sorted(self.databases)}")
        return self.databases[logical_db]

    def table(self, logical_db: str, table: str) -> DataFrame:
        if (logical_db, table) in self._registered:
            with self._building:
                found = self._registered[logical_db, table]
                if not isinstance(found, DataFrame):
                    found = self._registered[logical_db, table] = found()
            return found
        location = self._location(logical_db)
        schema, name = split_table_name(table)
        if "catalog" in location:
            return self.spark.table(".".join([location["catalog"], *([schema] if location.get("schemas") else []), name]))
        reader = self.spark.read.format(location["format"])
        if location["format"] == "jdbc":
            return reader.options(**self.jdbc_options(location, table)).load()
        folder = name if schema == DEFAULT_SCHEMA else f"{schema}/{name}"
        return reader.options(**location.get("options", {})).load(f"{location['path'].rstrip('/')}/{folder}")

    @staticmethod
    def jdbc_options(location: Mapping[str, Any], table: str) -> dict[str, Any]:
        """Options of the database and of the table. With a partition column the table is read by many tasks."""
        options = {**location.get("options", {}), **location.get("tables", {}).get(table, {}), "dbtable": table}
        bounds = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
        if "partitionColumn" in options and not bounds <= set(options):
            raise ValueError(f"a partitioned scan of '{table}' needs {sorted(bounds)}")
        return options

    def read_table(
        self, logical_db: str, table: str, columns: Sequence[str] | None = None, where: str | None = None
    ) -> DataFrame:
        """Scan with an SQL filter text and a projection; the filter may use columns that are not selected."""
        rows = self.table(logical_db, table)
        if where:
            rows = rows.where(where)
        return rows.select(*names(columns)) if columns else rows

    def read_query(self, logical_db: str, sql: str) -> DataFrame:
        """Any SELECT. Tables appear in braces: ``select count(*) as n from {orders}``.

        A JDBC database evaluates the query itself, so there the names are written without braces.
        """
        location = self.databases.get(logical_db, {})
        if location.get("format") == "jdbc":
            return self.spark.read.format("jdbc").options(**location["options"]).option("query", sql).load()
        used = {name for _, name, _, _ in Formatter().parse(sql) if name}
        return self.spark.sql(sql, **{name: self.table(logical_db, name) for name in used})

    def row_count(self, logical_db: str, table: str, where: str | None = None) -> DataFrame:
        """One row ``cnt``."""
        return self.read_table(logical_db, table, where=where).selectExpr("count(1) as cnt")

    def columns(self, logical_db: str, table: str) -> list[str]:
        return self.table(logical_db, table).schema.names

    def side(
        self, layer: LayerSpec, table: TableSpec, side: str, columns: Sequence[str] | None = None, counting: bool = False
    ) -> DataFrame:
        """Source or target of a movement under the filter of the layer."""
        filters = layer.filters(table)
        if side == "source":
            where = filters.count_source if counting else filters.source
            return self.read_table(layer.source_db, table.source_table, columns, where)
        where = filters.count_target if counting else filters.target
        return self.read_table(layer.target_db, table.target_table, columns, where)
