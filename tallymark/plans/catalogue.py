"""The catalogue of checks that belong to a pipeline, and their selection by tag."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import fixed_values as fixed
from tallymark.functions.text import lit, names
from tallymark.plans import checks
from tallymark.sources.literal import literal_rows
from tallymark.spec import LayerSpec, PipelineSpec, TableSpec

BASE_CHECKS = (checks.METADATA, checks.COUNT, checks.DUPLICATE, checks.NULL, checks.CONSTRAINT)


@dataclass(frozen=True)
class CheckCase:
    seq: int
    layer: str
    table: str
    check: str
    tags: tuple[str, ...]


def documented_checks(layer: LayerSpec) -> list[str]:
    """Base checks, the exact copy or the integrity check, and the rules where rows are cleansed and rejected."""
    extra = [checks.DIRECT_MOVE] if layer.direct_move else [checks.INTEGRITY]
    if layer.valid_filter:
        extra.append(checks.TRANSFORMATION)
    return [*BASE_CHECKS, *extra]


def table_checks(layer: LayerSpec, table: TableSpec) -> list[str]:
    """Everything that runs for a table: the documented checks and the fact checks it declares."""
    extra = [checks.FOREIGN_KEY] if table.foreign_keys else []
    extra += [checks.COLUMN_VALUES] if table.value_columns else []
    return [*documented_checks(layer), *extra]


def tags_of(layer: LayerSpec, table: TableSpec, check: str) -> tuple[str, ...]:
    tags = [fixed.LAYER_TAGS.get(layer.name, layer.name.lower()), table.name.lower()]
    tags += fixed.CHECK_TAGS.get(check, [])
    if table.dim_type == "Fact":
        tags.append("fact")
    return tuple(tags)


def cases(pipeline: PipelineSpec) -> list[CheckCase]:
    """The checks of a run in order: layer by layer, table by table."""
    found: list[CheckCase] = []
    for layer in pipeline.layers.values():
        for table in layer.tables.values():
            for check in table_checks(layer, table):
                found.append(CheckCase(len(found), layer.name, table.name, check, tags_of(layer, table, check)))
    return found


def case_prefixes(pipeline: PipelineSpec) -> dict[tuple[str, str], str]:
    """Layer and table in the ids of the cases: short where that is unique, else longer, and numbered if nothing else helps."""
    every = [(layer.name, table) for layer in pipeline.layers.values() for table in layer.tables]

    def forms(layer: str, table: str) -> list[str]:
        code = fixed.LAYER_CODES.get(layer, layer.upper()[:5])
        return [f"{code}_{table[:3].upper()}", f"{code}_{table.upper()}", f"{layer.upper()}_{table.upper()}"]

    listed = [forms(*at) for at in every]
    uses = [Counter(f[i] for f in listed) for i in range(3)]
    taken: dict[str, int] = {}
    chosen = {}
    for at, own in zip(every, listed, strict=True):
        prefix = next((own[i] for i in range(3) if uses[i][own[i]] == 1), own[2])
        taken[prefix] = taken.get(prefix, 0) + 1
        chosen[at] = prefix if taken[prefix] == 1 else f"{prefix}_{taken[prefix]}"
    return chosen


def check_catalogue(spark: SparkSession, pipeline: PipelineSpec) -> DataFrame:
    """One documented test case for each (layer, table, check), numbered within layer and table, with its tags."""
    rows, prefixes = [], case_prefixes(pipeline)
    for layer in pipeline.layers.values():
        for table in layer.tables.values():
            lists = {
                "keys": ", ".join(table.key),
                "not_null": ", ".join(table.not_null_columns),
                "compare": ", ".join(table.compare_columns),
                "rules": ", ".join(r.column for r in table.transformations),
            }
            filled = {
                **lists,
                "source": table.source_table,
                "target": table.target_table,
                "rules": "; ".join(f"{r.column} ({r.description})" for r in table.transformations),
            }
            for number, check in enumerate(documented_checks(layer), start=1):
                kind, columns, description, steps, expected, priority = fixed.CATALOGUE_TEXTS[check]
                rows.append(
                    (
                        f"TC_{prefixes[layer.name, table.name]}_{number:03d}",
                        layer.name,
                        table.name,
                        lists[columns],
                        kind,
                        description.format(**filled),
                        fixed.PRECONDITION,
                        steps.format(**filled),
                        expected.format(**filled),
                        priority,
                        check,
                        list(tags_of(layer, table, check)),
                    )
                )
    types = {**dict.fromkeys(fixed.CATALOGUE_COLUMNS, "string"), "tags": "array<string>"}
    return literal_rows(spark, types, rows)


def select_by_tags(catalogue: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Mark each case RUN when it carries any of the wanted tags, SKIP (with the reason) otherwise."""
    chosen = f"arrays_overlap(tags, array({', '.join(lit(t) for t in wanted)}))"
    reason = lit(fixed.SKIPPED_BY_SELECTION.format(only=" or ".join(wanted)))
    return catalogue.selectExpr(
        "*", f"if({chosen}, 'RUN', 'SKIP') as action", f"if({chosen}, null, {reason}) as reason"
    )


def first_cases(catalogue: DataFrame) -> DataFrame:
    """One case for each (layer, table, validation): the one with the smallest id."""
    columns = catalogue.schema.names
    ordered = ", ".join(names(["TestCaseID", *[c for c in columns if c != "TestCaseID"]]))
    first = catalogue.groupBy("Layer", "Table", "Suggested Validation").agg(
        F.expr(f"min(struct({ordered})) as first")
    )
    return first.select("first.*").select(*names(columns))
