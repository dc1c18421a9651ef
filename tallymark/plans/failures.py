"""Failure records: the rows behind failed comparisons, in the layout of the detailed report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tallymark import fixed_values as fixed
from tallymark.functions.normalize import as_text
from tallymark.functions.text import aliased, field, lit, names, quoted
from tallymark.operators.compare import SOURCE_ONLY, TARGET_ONLY, Comparison
from tallymark.operators.pairing import key_names, normalised_keys
from tallymark.plans.suite import SuiteRun

# failure types in the order of the report
_DIFF, _MISSING_TARGET, _MISSING_SOURCE, _DUPLICATE = range(4)
_PLACES = ("Source", "Target")
_HEAP_ROWS = 100_000


def key_texts(comparison: Comparison) -> str:
    """Normalised key as array of texts, the order of all detail lists."""
    texts = [f"coalesce(cast({quoted(n)} as string), 'None')" for n in key_names(comparison.keys)]
    return f"array({', '.join(texts)})"


def comparison_records(comparison: Comparison, layer_name: str, layer_number: int = 0) -> DataFrame:
    """All failure records of one comparison, uncapped.

    A differing record gives two rows, source and target, with the differing columns in ``highlight``; missing and
    duplicated rows are highlighted as a whole. Columns are those of the source table, shown as text.
    """
    schemas = {"Source": comparison.source.schema, "Target": comparison.target.schema}
    label = lit(fixed.LAYER_LABELS.get(layer_name, layer_name))
    keys = key_texts(comparison)

    def record(kind: int, ftype: str, place: str, row: str | None, highlight: str) -> dict[str, str]:
        schema = schemas[place]

        def cell(c: str) -> str:
            if c not in schema.names:
                return "cast(null as string)"
            return as_text(field(row, c) if row else quoted(c), schema[c].dataType)

        return {
            "layer": label,
            "failure_type": lit(ftype),
            "row_destination": lit(place),
            **{c: cell(c) for c in comparison.columns},
            "highlight": highlight,
            "_layer": str(layer_number),
            "_kind": str(kind),
            "_key": keys,
        }

    def whole(place: str) -> str:
        return f"array({', '.join(lit(c) for c in schemas[place].names)})"

    conditional = [("n_diffs > 0", record(_DIFF, "DF", p, f"{p.lower()}_row", "diff_columns")) for p in _PLACES]
    for kind, state, place, ftype in (
        (_MISSING_TARGET, SOURCE_ONLY, "Source", "Missing in Target"),
        (_MISSING_SOURCE, TARGET_ONLY, "Target", "Missing in Source"),
    ):
        conditional.append((f"state = '{state}'", record(kind, ftype, place, f"{place.lower()}_row", whole(place))))
    # all records of one key at once, so that the pairing runs once
    structs = [
        f"if({condition}, named_struct({', '.join(f'{lit(n)}, {v}' for n, v in built.items())}), null)"
        for condition, built in conditional
    ]
    parts = [comparison.issues.selectExpr(f"inline(array_compact(array({', '.join(structs)})))")]
    for place in _PLACES:
        rows = comparison.duplicates_on(place.lower())
        rows = rows.selectExpr("*", *normalised_keys(rows, comparison.keys))
        built = record(_DUPLICATE, f"Duplicate in {place}", place, None, whole(place))
        parts.append(rows.selectExpr(*aliased(built)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def failure_records(run: SuiteRun, table: str, max_rows: int | None = None) -> DataFrame:
    """Failure records of one table over all layers and all checks that compared it (column ``validation``).

    Order: layer, then differing, missing in target, missing in source, duplicated records, each by key text. All records are
    returned; only on request (``max_rows`` or the setting of the pipeline) the first ones, which Spark takes as a top-k.
    """
    parts, columns = [], []
    for number, layer in enumerate(run.pipeline.layers):
        for check in run.compared.get((layer, table), ()):
            comparison = run.comparison(layer, table, check)
            parts.append(comparison_records(comparison, layer, number).selectExpr("*", f"{lit(check)} as validation"))
            columns += [c for c in comparison.columns if c not in columns]
    if not parts:
        raise ValueError(f"no comparison ran for table '{table}'")
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = ["_layer", "_kind", "_key", "row_destination", *names(columns)]
    limit = run.pipeline.max_detail_rows if max_rows is None else max_rows
    ordered = records.orderBy(*order, "validation")
    kept = ordered if limit is None else ordered.limit(limit)
    return kept.select("layer", "validation", "failure_type", "row_destination", *names(columns), "highlight")


def detail_records(run: SuiteRun, max_rows: int) -> DataFrame:
    """The first ``max_rows`` failure records of every compared table over all its layers and checks, all tables in one plan.

    Columns are the same for all tables: ``layer``, ``table``, ``validation``, ``failure_type``, ``row_destination``, ``key``, ``row`` (the
    cells as JSON), ``highlight``, ``rank`` (from 1 in each table, in the order of ``failure_records``), ``total`` and ``left_out``: the
    records of the table, and those that are not shown. Every task hands on at most ``max_rows`` records of a table; without a limit,
    ``failure_records`` returns them all. A table without failures has no rows; a run without comparisons is an error.
    """
    layers, parts = list(run.pipeline.layers), {}
    for (layer, table, check), comparison in run.comparisons().items():
        cells = ", ".join(f"{lit(c)}, {quoted(c)}" for c in comparison.columns)
        parts.setdefault(table, []).append(
            comparison_records(comparison, layer, layers.index(layer)).selectExpr(
                "layer", f"{lit(table)} as `table`", f"{lit(check)} as validation", "failure_type", "row_destination",
                "array_join(_key, '|') as key", f"to_json(map({cells})) as `row`", "highlight", "_layer", "_kind", "_key",
            )
        )
    if not parts:
        raise ValueError("no comparison ran")
    of_tables = [reduce(lambda a, b: a.unionByName(b), found) for found in parts.values()]
    order = ["_layer", "_kind", "_key", "row_destination", "validation", "`row`"]
    # a limit behind an order is a heap of so many records in every task, where a window alone would sort all of them
    few = int(max_rows) <= _HEAP_ROWS
    first = reduce(lambda a, b: a.unionByName(b), [rows.orderBy(*order).limit(int(max_rows)) if few else rows for rows in of_tables])
    ranked = first.selectExpr("*", f"row_number() over (partition by `table` order by {', '.join(order)}) as rank").where(f"rank <= {int(max_rows)}")
    counted = reduce(lambda a, b: a.unionByName(b), [rows.select("table") for rows in of_tables])
    totals = counted.groupBy("table").count().hint("broadcast")  # one row for each table
    return ranked.join(totals, "table").selectExpr(
        "layer", "`table`", "validation", "failure_type", "row_destination", "key", "`row`", "highlight", "rank",
        "`count` as total", f"greatest(0L, `count` - {int(max_rows)}) as left_out",
    )
