"""Data reconciliation and data-quality checks as Spark plans."""

from tallymark.operators.compare import Comparison, compare
from tallymark.spec import (
    ConstraintSpec,
    ForeignKeySpec,
    LayerSpec,
    LookupSpec,
    PipelineSpec,
    RuleSpec,
    TableSpec,
    load_pipeline,
)

__all__ = [
    "Comparison",
    "ConstraintSpec",
    "ForeignKeySpec",
    "LayerSpec",
    "LookupSpec",
    "PipelineSpec",
    "RuleSpec",
    "TableSpec",
    "compare",
    "load_pipeline",
]
