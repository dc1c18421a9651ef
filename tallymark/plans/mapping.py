"""Source-to-target mapping document and constraint labels."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import fixed_values as fixed
from tallymark.functions.text import aliased, case, lit
from tallymark.sources.literal import literal_rows
from tallymark.sources.metadata import column_metadata, column_profile, fallback_metadata
from tallymark.sources.tables import TableStore
from tallymark.spec import ConstraintSpec, LayerSpec, PipelineSpec, TableSpec

_LABELS = {"PRIMARY KEY": "PK", "UNIQUE": "UNIQUE"}
_METADATA = ["name", "ordinal", "data_type", "size", "nullable"]


def _label(constraint: ConstraintSpec) -> str:
    if constraint.kind == "FOREIGN KEY":
        return f"FK -> {constraint.ref_table}"
    return _LABELS[constraint.kind]


def declared_labels(spark: SparkSession, pipeline: PipelineSpec, table_name: str, table: TableSpec) -> DataFrame:
    """Rows (column, position, label) from declared constraints, the business key and the required columns."""
    declared = [c for c in pipeline.constraints if c.table == table_name]
    keyed = {c.column for c in declared if c.kind == "PRIMARY KEY"}
    # primary and unique keys come before foreign keys, then what the table spec knows
    labels = [(c.column, _label(c)) for c in declared if c.kind != "FOREIGN KEY"]
    labels += [(c.column, _label(c)) for c in declared if c.kind == "FOREIGN KEY"]
    labels += [(k, "Business Key") for k in table.key if k not in keyed]
    labels += [(c, "NOT NULL") for c in table.not_null_columns]
    rows = [(column, i, label) for i, (column, label) in enumerate(labels)]
    return literal_rows(spark, {"label_column": "string", "position": "int", "label": "string"}, rows)


def constraint_text(labels: DataFrame) -> DataFrame:
    """One row for each column: its labels in order, each once, joined by commas."""
    ordered = "transform(array_sort(collect_list(struct(position, label))), x -> x.label)"
    return labels.groupBy("label_column").agg(
        F.expr(f"concat_ws(', ', array_distinct({ordered})) as constraints")
    )


def _one_of(names: Iterable[str]) -> str:
    return f"lower(name) in ({', '.join(lit(n) for n in names)})"


def _rule(layer: LayerSpec, table: TableSpec) -> str:
    """Transformation-rule text of a target column (``name``); ``s_name`` is NULL when it has no source."""
    has_source, not_in_source = "s_name is not null", lit(fixed.RULE_NOT_IN_SOURCE)
    if layer.direct_move:
        return case([(has_source, lit(fixed.RULE_DIRECT))], not_in_source)
    audit = (_one_of(fixed.AUDIT_COLUMNS), lit(fixed.RULE_AUDIT))
    if layer.valid_filter:
        texts: dict[str, list[str]] = {}
        for rule in table.transformations:
            texts.setdefault(rule.column, []).append(rule.text)
        choices = [(f"name = {lit(column)}", lit("; ".join(parts))) for column, parts in texts.items()]
        choices += [
            (_one_of(["isvalid"]), lit(fixed.RULE_VALID_FLAG)),
            (_one_of(["rejectionreason"]), lit(fixed.RULE_REJECTION_REASON)),
            audit,
            (has_source, lit(fixed.RULE_CLEANED)),
        ]
        return case(choices, not_in_source)
    loaded = fixed.RULE_DIMENSION.get(table.dim_type, fixed.RULE_WAREHOUSE)
    choices = [
        ("endswith(lower(name), 'sk')", lit(fixed.RULE_SURROGATE_KEY)),
        (_one_of(fixed.SCD_COLUMNS), lit(fixed.RULE_SCD)),
        audit,
        (has_source, lit(loaded)),
    ]
    return case(choices, lit(loaded + fixed.RULE_DERIVED_SUFFIX))


def _metadata(store: TableStore, database: str, name: str, table: TableSpec, observed: bool) -> DataFrame:
    try:
        df = store.table(database, name)
    except (AnalysisException, ValueError):
        return fallback_metadata(store.spark, table.compare_columns)
    return (column_profile(df) if observed else column_metadata(df)).select(*_METADATA)


def mapping_document(store: TableStore, pipeline: PipelineSpec, layer_name: str, observed: bool = False) -> DataFrame:
    """One row for each target column of a layer, mapped to its source column by name, whatever the case.

    ``observed`` takes sizes and nullability from the data instead of the schema. ``seq`` orders the rows.
    """
    layer = pipeline.layer(layer_name)
    parts = []
    for number, table in enumerate(layer.tables.values()):
        sides = {}
        for prefix, database, name in (
            ("s_", layer.source_db, table.source_table),
            ("", layer.target_db, table.target_table),
        ):
            columns = _metadata(store, database, name, table, observed)
            labels = constraint_text(declared_labels(store.spark, pipeline, name, table))
            labelled = columns.join(labels, F.expr("name = label_column"), "left")
            sides[prefix] = labelled.selectExpr(*[f"{c} as {prefix}{c}" for c in [*_METADATA, "constraints"]])
        rows = sides[""].join(sides["s_"], F.expr("lower(name) = lower(s_name)"), "left")

        def from_source(value: str) -> str:
            return f"if(s_name is null, '', coalesce({value}, ''))"

        values = [
            from_source(lit(pipeline.database(layer.source_db))),
            from_source(lit(table.source_table)),
            *[from_source(c) for c in ("s_name", "s_data_type", "s_size", "s_nullable", "s_constraints")],
            _rule(layer, table),
            lit(pipeline.database(layer.target_db)),
            lit(table.target_table),
            "name",
            "data_type",
            "size",
            "nullable",
            "coalesce(constraints, '')",
        ]
        named = aliased(dict(zip(fixed.MAPPING_COLUMNS, values)))
        parts.append(rows.selectExpr(*named, f"{number * 10_000} + ordinal as seq"))
    return reduce(lambda a, b: a.unionByName(b), parts)
