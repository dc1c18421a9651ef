"""Declarative description of layers, tables, keys, compared columns and rules.

The specs say *what* is checked; every DataFrame plan in the package is built from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class RuleSpec:
    """A data-quality rule on one target column."""

    column: str
    rule: str
    value: Any = None
    description: str | None = None

    @property
    def text(self) -> str:
        return self.description or f"{self.rule} = {self.value}"


@dataclass(frozen=True)
class ForeignKeySpec:
    """A surrogate key of a fact table and the dimension column it must exist in."""

    column: str
    ref_table: str
    ref_column: str
    allow_null: bool = False
    null_aware: bool = False  # True: SQL NOT IN semantics, one NULL in the dimension hides every orphan


@dataclass(frozen=True)
class LookupSpec:
    """Replace a natural key by a surrogate key while loading a fact.

    ``carry`` brings further dimension columns along, so that a later lookup can go through this one.
    """

    key: str
    ref_table: str
    ref_key: str
    surrogate_key: str
    carry: tuple[str, ...] = ()


@dataclass(frozen=True)
class ConstraintSpec:
    """A declared constraint; Spark sources do not expose them, so the spec states them."""

    table: str
    column: str
    kind: str  # PRIMARY KEY, UNIQUE, FOREIGN KEY
    ref_table: str | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    source_table: str
    target_table: str
    key: tuple[str, ...]
    compare_columns: tuple[str, ...] = ()
    not_null_columns: tuple[str, ...] = ()
    transformations: tuple[RuleSpec, ...] = ()
    target_filter: str | None = None
    dim_type: str = ""
    foreign_keys: tuple[ForeignKeySpec, ...] = ()
    value_columns: tuple[str, ...] = ()
    surrogate_key: str | None = None
    lower_case_columns: tuple[str, ...] = ()
    lookups: tuple[LookupSpec, ...] = ()

    @property
    def expected_columns(self) -> list[str]:
        """Keys, then the compared columns that are not keys, in order."""
        return list(dict.fromkeys([*self.key, *self.compare_columns]))


@dataclass(frozen=True)
class SideFilters:
    source: str | None
    target: str | None
    count_source: str | None
    count_target: str | None


@dataclass(frozen=True)
class LayerSpec:
    """One movement of the warehouse, for example PreStaging to Staging."""

    name: str
    source_db: str
    target_db: str
    tables: Mapping[str, TableSpec]
    valid_filter: str | None = None  # accepted rows of a target that also keeps the rejected ones
    source_valid_filter: str | None = None
    direct_move: bool = False  # exact copy: compared case-sensitively
    tolerate_missing_in_target: bool = False  # rejected source rows may be absent from the accepted target

    def table(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise ValueError(f"Table '{name}' not found in layer '{self.name}'.")
        return self.tables[name]

    def filters(self, table: TableSpec) -> SideFilters:
        """Row filters per side. Counts ignore ``valid_filter``: accepted plus rejected rows must add up."""
        return SideFilters(
            source=self.source_valid_filter,
            target=table.target_filter or self.valid_filter,
            count_source=self.source_valid_filter,
            count_target=table.target_filter,
        )


@dataclass(frozen=True)
class PipelineSpec:
    layers: Mapping[str, LayerSpec]
    databases: Mapping[str, str] = field(default_factory=dict)  # logical name -> physical name
    constraints: tuple[ConstraintSpec, ...] = ()
    max_detail_rows: int | None = None  # rows of a detailed report; None: all
    known_defects: Mapping[tuple[str, str], str] = field(default_factory=dict)  # (layer, table) -> hint

    def layer(self, name: str) -> LayerSpec:
        if name not in self.layers:
            raise ValueError(f"Unknown layer '{name}'. Valid layers: {list(self.layers)}")
        return self.layers[name]

    def table(self, layer: str, name: str) -> TableSpec:
        return self.layer(layer).table(name)

    def database(self, logical: str) -> str:
        return self.databases.get(logical, logical)


DEFAULT_SCHEMA = "dbo"


def split_table_name(table: str, default_schema: str = DEFAULT_SCHEMA) -> tuple[str, str]:
    """``'dbo.SRC_Accounts'`` -> ``('dbo', 'SRC_Accounts')``; a bare name gets the default schema."""
    schema, dot, name = table.partition(".")
    return (schema, name) if dot else (default_schema, table)


def table_path(table: str) -> str:
    """Folder of a table below its database: schema and name, so that equal names of two schemas stay apart."""
    return "/".join(split_table_name(table))


def _known(cls: type, values: Mapping[str, Any], where: str) -> dict[str, Any]:
    unknown = set(values) - set(cls.__dataclass_fields__)
    if unknown:
        raise ValueError(f"Unknown setting(s) {sorted(unknown)} in {where}")
    return dict(values)


def _many(cls: type, items: Iterable[Mapping[str, Any]] | None, where: str) -> tuple:
    built = []
    for item in items or ():
        values = _known(cls, item, where)
        built.append(cls(**{k: tuple(v) if k == "carry" else v for k, v in values.items()}))
    return tuple(built)


def table_from_dict(name: str, block: Mapping[str, Any]) -> TableSpec:
    block = {k: v for k, v in block.items() if k != "load_proc"}
    values = _known(TableSpec, block, f"table '{name}'")
    for column_list in ("key", "compare_columns", "not_null_columns", "value_columns", "lower_case_columns"):
        values[column_list] = tuple(values.get(column_list) or ())
    values["transformations"] = _many(RuleSpec, block.get("transformations"), f"rules of '{name}'")
    values["foreign_keys"] = _many(ForeignKeySpec, block.get("foreign_keys"), f"foreign keys of '{name}'")
    values["lookups"] = _many(LookupSpec, block.get("lookups"), f"lookups of '{name}'")
    values["dim_type"] = values.get("dim_type") or ""
    values.pop("name", None)
    return TableSpec(name=name, **values)


def layer_from_dict(block: Mapping[str, Any]) -> LayerSpec:
    name = block["layer"]
    options = {k: v for k, v in block.items() if k not in ("layer", "tables")}
    # The first movement is an exact copy and the second one may reject rows, unless the file says otherwise.
    options.setdefault("direct_move", name == "SourceToPreStaging")
    options.setdefault("tolerate_missing_in_target", name == "PreStagingToStaging")
    tables = {t: table_from_dict(t, b) for t, b in (block.get("tables") or {}).items()}
    return LayerSpec(name=name, tables=tables, **_known(LayerSpec, options, f"layer '{name}'"))


def load_pipeline(settings_file: str | Path, *layer_files: str | Path) -> PipelineSpec:
    """Read the global settings and one YAML file for each layer, in layer order."""
    try:
        import yaml
    except ImportError as missing:  # pragma: no cover - depends on the installation
        raise RuntimeError("reading YAML specs needs PyYAML; build the specs in Python instead") from missing

    def read(path: str | Path) -> dict[str, Any]:
        with open(path, encoding="utf-8") as handle:
            return yaml.safe_load(handle) or {}

    settings = read(settings_file)
    layers = [layer_from_dict(read(path)) for path in layer_files]
    return PipelineSpec(
        layers={layer.name: layer for layer in layers},
        databases=settings.get("databases", {}),
        constraints=_many(ConstraintSpec, settings.get("constraints"), "constraints"),
        max_detail_rows=(settings.get("reporting") or {}).get("max_detail_rows"),
        known_defects={(d["layer"], d["table"]): d["hint"] for d in settings.get("known_defects") or ()},
    )
