"""Layer loads: exact copy, cleansing with rejection, Type-1 and Type-2 dimensions, fact with surrogate keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.normalize import strip, values_equal
from tallymark.functions.rules import broken
from tallymark.functions.text import aliased, case, field, joined, listed, lit, names, quoted
from tallymark.operators.duplicates import mark_first
from tallymark.operators.lookup import lookup
from tallymark.operators.numbering import number_rows
from tallymark.operators.pairing import pair_by_key
from tallymark.session import HOT_KEY_ROWS
from tallymark.sources.tables import TableStore
from tallymark.spec import LayerSpec, LookupSpec, PipelineSpec, TableSpec, table_path

VALID, REASON = "IsValid", "RejectionReason"
CURRENT, EFFECTIVE, EXPIRY = "IsCurrent", "EffectiveDate", "ExpiryDate"
DUPLICATE_KEY = "Duplicate business key"


def load_direct(source: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Source to PreStaging: an exact copy."""
    return source.select(*names(columns or source.schema.names))


def cleanse(rows: DataFrame, lower_case_columns: Sequence[str] = ()) -> DataFrame:
    """Trim all text and standardise its case: upper, except for the given columns (e-mail addresses)."""
    built = {}
    for f in rows.schema.fields:
        built[f.name] = quoted(f.name)
        if isinstance(f.dataType, T.StringType):
            built[f.name] = f"{'lower' if f.name in lower_case_columns else 'upper'}({strip(quoted(f.name))})"
    return rows.selectExpr(*aliased(built))


def load_staging(rows: DataFrame, table: TableSpec, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """PreStaging to Staging: cleanse; keep bad and duplicate rows with ``IsValid = 0`` and the reasons.

    Of several rows with one key, the first row that breaks no rule is accepted.
    """
    clean = cleanse(rows, table.lower_case_columns)
    problems = [(f"{quoted(c)} is null", f"{c} is missing") for c in table.not_null_columns]
    problems += [(broken(r, clean.schema), r.text) for r in table.transformations]
    reasons = [case([(condition, lit(text))]) for condition, text in problems]
    judged = clean.selectExpr("*", f"{joined('; ', reasons)} as _bad").selectExpr("*", "_bad != '' as _is_bad")
    marked = mark_first(judged, table.key, ["_is_bad"], hot_rows)
    reason = joined("; ", ["nullif(_bad, '')", f"if(_first, null, {lit(DUPLICATE_KEY)})"])
    return marked.selectExpr(
        *names(clean.schema.names), f"if({reason} = '', 1, 0) as {VALID}", f"nullif({reason}, '') as {REASON}"
    )


def _largest(dimension: DataFrame, column: str) -> int:
    return dimension.selectExpr(f"max({quoted(column)}) as n").first()["n"] or 0


def _from_row(side: str, columns: Sequence[str]) -> dict[str, str]:
    return {c: field(f"{side}_row", c) for c in columns}


def load_scd1(
    current: DataFrame | None, incoming: DataFrame, keys: Sequence[str], surrogate_key: str
) -> DataFrame:
    """Type-1 dimension: the latest value overwrites, one row for each key; new keys get new surrogate keys."""
    columns = incoming.schema.names
    output = names([surrogate_key, *columns])
    if current is None:
        return number_rows(_first_versions(incoming, keys), keys, surrogate_key).select(*output)
    pairs = pair_by_key(current, incoming, keys, columns)
    latest = {
        c: f"if(n_target > 0, {field('target_row', c)}, {field('source_row', c)})" for c in columns
    }
    known = pairs.where("n_source > 0").selectExpr(*aliased({**_from_row("source", [surrogate_key]), **latest}))
    fresh = pairs.where("n_source = 0").selectExpr(*aliased(_from_row("target", columns)))
    numbered = number_rows(fresh, keys, surrogate_key, _largest(current, surrogate_key))
    return known.unionByName(numbered)


def _first_versions(incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key."""
    by = [F.expr(f"{quoted(k)} as {quoted('__' + k)}") for k in keys]
    first = incoming.groupBy(*by).agg(F.expr(f"min(struct({listed(incoming.schema.names)})) as row"))
    return first.select("row.*")


def load_scd2(
    current: DataFrame | None, incoming: DataFrame, keys: Sequence[str], surrogate_key: str, effective: datetime
) -> DataFrame:
    """Type-2 dimension: a changed row expires and a new current version follows; history stays as it is.

    Only the current versions take part in the join. A key that is absent from the incoming rows stays current.
    """
    columns = incoming.schema.names
    output = [surrogate_key, *columns, CURRENT, EFFECTIVE, EXPIRY]
    valid_from = f"timestamp_ntz'{effective.isoformat(sep=' ')}'"

    def new_versions(rows: DataFrame, start: int) -> DataFrame:
        version = {CURRENT: "1", EFFECTIVE: valid_from, EXPIRY: "cast(null as timestamp_ntz)"}
        numbered = number_rows(rows, keys, surrogate_key, start)
        return numbered.selectExpr("*", *aliased(version)).select(*names(output))

    if current is None:
        return new_versions(_first_versions(incoming, keys), 0)

    history = current.where(f"not ({CURRENT} <=> 1)").select(*names(output))
    active = current.where(f"{CURRENT} = 1")
    same = [
        values_equal(
            field("source_row", c), active.schema[c].dataType, field("target_row", c), incoming.schema[c].dataType
        )
        for c in columns
        if c not in keys
    ]
    differs = f"array_contains(array({', '.join(same)}), false)" if same else "false"
    changed = f"n_source > 0 and n_target > 0 and {differs}"
    pairs = pair_by_key(active, incoming, keys, columns).selectExpr("*", f"{changed} as changed")

    kept = _from_row("source", output)
    kept[CURRENT] = f"if(changed, 0, {kept[CURRENT]})"
    kept[EXPIRY] = f"if(changed, {valid_from}, {kept[EXPIRY]})"
    previous = pairs.where("n_source > 0").selectExpr(*aliased(kept))
    fresh = pairs.where("changed or n_source = 0").selectExpr(*aliased(_from_row("target", columns)))
    versions = new_versions(fresh, _largest(current, surrogate_key))
    return history.unionByName(previous).unionByName(versions)


def load_fact(rows: DataFrame, lookups: Sequence[LookupSpec], dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """Replace natural keys by surrogate keys; keys without a dimension row become NULL.

    ``dimensions`` holds the current rows of each dimension. A lookup may use a column carried by an earlier one.
    """
    found, natural = rows, []
    for spec in lookups:
        take = {spec.surrogate_key: spec.surrogate_key, **{c: c for c in spec.carry}}
        found = lookup(found, spec.key, dimensions[spec.ref_table], spec.ref_key, take)
        natural += [spec.key, *spec.carry]
    return found.drop(*natural)


# ---- all layers --------------------------------------------------------------------------------------------------


def load_order(layer: LayerSpec) -> list[TableSpec]:
    """Parents before children, by lookups and foreign keys; otherwise the declared order. Cycles keep the declared order."""
    by_target = {t.target_table: t for t in layer.tables.values()}
    placed: dict[str, TableSpec] = {}
    open_tables: set[str] = set()

    def place(table: TableSpec) -> None:
        if table.name in placed or table.name in open_tables:
            return
        open_tables.add(table.name)
        for parent in [*[s.ref_table for s in table.lookups], *[k.ref_table for k in table.foreign_keys]]:
            if parent in by_target:
                place(by_target[parent])
        placed[table.name] = table

    for table in layer.tables.values():
        place(table)
    return list(placed.values())


def _dimension_filter(layer: LayerSpec, target_table: str) -> str | None:
    return next((t.target_filter for t in layer.tables.values() if t.target_table == target_table), None)


def reload_layers(
    spark: SparkSession,
    pipeline: PipelineSpec,
    sources: Mapping[str, DataFrame],
    root: str,
    effective: datetime,
    previous: TableStore | None = None,
) -> TableStore:
    """Load every layer from the source tables into folders under ``root``, each stage overwriting its output.

    ``sources`` maps the source table names of the first layer to DataFrames. Each stage reads what the stage before
    it wrote, so a lost executor costs one stage at most. ``previous`` supplies the dimensions of the last load, which
    must lie under another root; without it dimensions start empty.
    """
    store = TableStore(spark)
    layers = list(pipeline.layers.values())
    for name, df in sources.items():
        store.register(layers[0].source_db, name, df)

    def save(layer: LayerSpec, table: TableSpec, df: DataFrame) -> None:
        path = f"{root.rstrip('/')}/{layer.target_db}/{table_path(table.target_table)}"
        df.write.mode("overwrite").parquet(path)
        store.register(layer.target_db, table.target_table, spark.read.parquet(path))

    for layer in layers:
        for table in load_order(layer):
            save(layer, table, load_stage(store, previous, layer, table, effective))
    return store


def load_stage(
    store: TableStore, previous: TableStore | None, layer: LayerSpec, table: TableSpec, effective: datetime
) -> DataFrame:
    """The load of one table in one layer, by the kind of its layer and table."""
    rows = store.read_table(layer.source_db, table.source_table, where=layer.source_valid_filter)
    if layer.direct_move:
        return load_direct(rows)
    if layer.valid_filter:
        return load_staging(rows, table)
    return _load_warehouse_table(store, previous, layer, table, rows.drop(VALID, REASON), effective)


def _load_warehouse_table(
    store: TableStore,
    previous: TableStore | None,
    layer: LayerSpec,
    table: TableSpec,
    rows: DataFrame,
    effective: datetime,
) -> DataFrame:
    if table.lookups:
        dimensions = {
            spec.ref_table: store.read_table(
                layer.target_db, spec.ref_table, where=_dimension_filter(layer, spec.ref_table)
            )
            for spec in table.lookups
        }
        kept = dict.fromkeys([*table.expected_columns, *[s.key for s in table.lookups if s.key in rows.schema.names]])
        return load_fact(rows.select(*names(kept)), table.lookups, dimensions)
    current = previous.table(layer.target_db, table.target_table) if previous else None
    if table.dim_type == "Type2":
        return load_scd2(current, rows, table.key, table.surrogate_key, effective)
    return load_scd1(current, rows, table.key, table.surrogate_key)
