"""Findings of failed checks, and defect tickets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import fixed_values as fixed
from tallymark.functions.normalize import shown
from tallymark.functions.rows import key_text, row_text
from tallymark.functions.text import aliased, case, concat, field, joined, lit, names, python_list, quoted
from tallymark.operators.compare import SOURCE_ONLY, TARGET_ONLY
from tallymark.operators.duplicates import duplicate_keys
from tallymark.operators.numbering import number_rows
from tallymark.plans import checks
from tallymark.plans.catalogue import CheckCase, cases
from tallymark.plans.failures import key_texts
from tallymark.plans.suite import SuiteRun

FINDING_COLUMNS = [
    "layer", "table", "validation", "type", "severity", "title", "expected", "actual", "root_cause", "fix",
]
_ORDER = ["_seq", "_kind", "_key", "_part"]


def text(template: str, **values: str) -> str:
    """Text with ``<name>`` placeholders for string expressions."""
    parts: list[str] = []
    rest = template
    while "<" in rest:
        before, _, tail = rest.partition("<")
        name, _, rest = tail.partition(">")
        parts += [lit(before), values[name]]
    return concat(*parts, lit(rest)) if parts else lit(rest)


def comparison_findings(
    run: SuiteRun, layer: str, table: str, check: str, include_tolerated: bool = False, seq: int = 0
) -> DataFrame:
    """One finding for each differing cell, missing row and duplicated key of a compared table.

    Everything derives from the paired keys: a duplicated key is one row there already, with its number of copies
    and its first row as the example, so duplicates are not gathered again.
    """
    ctx = run.contexts[layer, table]
    comparison, spec = ctx.comparison(check), ctx.table
    st, tt = spec.source_table, spec.target_table
    sdb, tdb = run.pipeline.database(ctx.layer.source_db), run.pipeline.database(ctx.layer.target_db)
    hint = run.pipeline.known_defects.get((layer, table), "")
    keys, issues, key_order = comparison.keys, comparison.issues, key_texts(comparison)
    source, target = comparison.source.schema, comparison.target.schema

    def finding(kind: int, part: str, **texts: str) -> str:
        """One finding as struct; all kinds have the same fields."""
        order = {"_seq": str(seq), "_kind": str(kind), "_key": key_order, "_part": part}
        named = {"layer": lit(layer), "table": lit(table), "validation": lit(check), **texts, **order}
        return f"named_struct({', '.join(f'{lit(name)}, {value}' for name, value in named.items())})"

    def cell(row: str, schema) -> str:
        return case(
            [(f"c = {lit(c)}", shown(field(row, c), schema[c].dataType)) for c in comparison.compare_columns], "''"
        )

    at = {"s": key_text(keys, source, "source_row"), "t": key_text(keys, target, "target_row")}
    whole = {"srow": row_text(keys, source, "source_row"), "trow": row_text(keys, target, "target_row")}
    differing = {"c": "c", "sv": cell("source_row", source), "tv": cell("target_row", target), **at}
    cause = text(
        f"The '<c>' value was not carried correctly from {st} to {tt} (it changed during the movement). {hint}",
        **differing,
    )
    mismatch = finding(
        0,
        "i",
        type=lit("Column Value Mismatch"),
        severity=lit("High"),
        title=text("<c> value differs at [<s>]", **differing),
        expected=text("<c> must be identical in source and target.", **differing),
        actual=text(
            f"[<s>] Column '<c>' -> Source {st}({sdb}) = '<sv>'  |  Target {tt}({tdb}) = '<tv>'", **differing
        ),
        root_cause=f"rtrim({cause})",
        fix=text(
            f"Fix the load logic so '<c>' is preserved, or correct the source data; then reload {tt}.", **differing
        ),
    )

    others = []
    if include_tolerated or not (ctx.layer.tolerate_missing_in_target and check == checks.INTEGRITY):
        missing = finding(
            1,
            "0",
            type=lit("Missing Record in Target"),
            severity=lit("High"),
            title=text(f"Record [<s>] is in source but MISSING in target ({tt})", **at),
            expected=lit(f"Every record in {st} must also exist in {tt}."),
            actual=text(f"Present in {st}({sdb}) but NOT found in {tt}({tdb}).\nSource row: <srow>", **whole),
            root_cause=text(
                f"Record [<s>] exists in {st} but was not loaded into {tt} - the row was dropped or rejected "
                "during the movement (check load filters / rejection logic).",
                **at,
            ),
            fix=lit(f"Investigate why the record was not loaded and reload {tt}."),
        )
        others.append((f"state = '{SOURCE_ONLY}'", missing))
    orphan = finding(
        2,
        "0",
        type=lit("Missing Record in Source (extra in target)"),
        severity=lit("Medium"),
        title=text(f"Record [<t>] is in target ({tt}) but MISSING in source", **at),
        expected=lit(f"{tt} must not contain records absent from {st}."),
        actual=text(f"Present in {tt}({tdb}) but NOT found in {st}({sdb}).\nTarget row: <trow>", **whole),
        root_cause=text(
            f"Record [<t>] exists in {tt} but not in {st} - an orphan/unexpected insert, or the source row was "
            "deleted after the target was loaded.",
            **at,
        ),
        fix=lit(f"Verify the source; remove the orphan {tt} row or restore the source record, then reconcile."),
    )
    others.append((f"state = '{TARGET_ONLY}'", orphan))
    for order, (side, name) in enumerate((("source", st), ("target", tt))):
        here = {"k": at[side[0]], "row": whole[f"{side[0]}row"], "n": f"cast(n_{side} as string)"}
        duplicate = finding(
            3,
            str(order),
            type=lit("Duplicate Record"),
            severity=lit("High"),
            title=text(f"Duplicate business key [<k>] on the {side} side", **here),
            expected=lit("Each business key must appear at most once."),
            actual=text(f"Duplicate in {name} ({side} side): key [<k>] appears <n> times. Example row: <row>", **here),
            root_cause=lit(
                f"Business key {python_list(keys)} appears more than once in {name} "
                "(missing de-duplication or unique key)."
            ),
            fix=lit("Add/enforce a unique constraint or a de-duplication step."),
        )
        others.append((f"is_duplicate and n_{side} > 1", duplicate))

    cells = f"transform(diff_columns, (c, i) -> {mismatch})"
    rest = f"array_compact(array({', '.join(f'if({condition}, {struct}, null)' for condition, struct in others)}))"
    return issues.selectExpr(f"inline(concat({cells}, {rest}))")


def _by_validation(texts: Mapping[str, str], default: str) -> str:
    return case([(f"validation = {lit(name)}", value) for name, value in texts.items()], default)


def _duplicate_findings(run: SuiteRun) -> list[DataFrame]:
    """One finding for each duplicated key of every table whose duplicate check failed."""
    kind, _ = fixed.CHECK_DEFECTS[checks.DUPLICATE]
    severity, expected = fixed.CHECK_EXPECTATIONS[checks.DUPLICATE][:2]
    seq = {(c.layer, c.table, c.check): c.seq for c in run_cases(run)}
    parts = []
    for (layer, table), ctx in run.contexts.items():
        if (layer, table, checks.DUPLICATE) not in run.failed:
            continue
        keys = ctx.table.key
        rows = ctx.side("target", keys)
        shown_keys = [shown(quoted(k), rows.schema[k].dataType) for k in keys]
        parts.append(
            duplicate_keys(rows, keys).selectExpr(
                *aliased(
                    {
                        "layer": lit(layer),
                        "table": lit(table),
                        "validation": lit(checks.DUPLICATE),
                        "type": lit(kind),
                        "severity": lit(severity),
                        "title": lit(f"{checks.DUPLICATE} failed"),
                        "expected": lit(expected),
                        "actual": f"concat('Duplicate key(s) in target: ', {joined('/', shown_keys)}, ' (x', cast(cnt as string), ')')",
                        "root_cause": lit(f"Business key {python_list(keys)} is duplicated in the target."),
                        "fix": lit(fixed.FIX_GENERIC),
                        "_seq": str(seq[layer, table, checks.DUPLICATE]),
                        "_kind": "0",
                        "_key": f"array({', '.join(shown_keys)})",
                        "_part": "0",
                    }
                )
            )
        )
    return parts


def check_findings(run: SuiteRun) -> DataFrame:
    """One finding for each failed check that has no row-level findings: from its metrics, or the message of an error."""
    detailed = ", ".join(lit(c) for c in (*checks.COMPARISONS, checks.DUPLICATE))
    failed = run.results.where(f"status = 'ERROR' or (status = 'FAIL' and validation not in ({detailed}))")
    source, target = "metrics['source']", "metrics['target']"
    count = {
        "s": f"cast({source} as string)",
        "t": f"cast({target} as string)",
        "d": f"cast({source} - {target} as string)",
        "way": f"if({source} > {target}, 'rows lost', 'extra rows')",
    }
    nulls = (
        "concat_ws('; ', transform(filter(map_entries(metrics), e -> e.value > 0), "
        "e -> concat(e.key, ' = ', cast(e.value as string), ' NULL(s)')))"
    )
    actual = {
        checks.COUNT: text("Source rows = <s>  |  Target rows = <t>  (diff = <d>)", **count),
        checks.NULL: concat(lit("NULLs in target required column(s): "), nulls),
    }
    causes = {v: lit(cause) for v, (_, cause) in fixed.CHECK_DEFECTS.items() if cause}
    causes[checks.COUNT] = text("Source and target counts differ by <d> (<way> in the movement).", **count)
    kinds = {v: lit(kind) for v, (kind, _) in fixed.CHECK_DEFECTS.items()}
    severities = {v: lit(e[0]) for v, e in fixed.CHECK_EXPECTATIONS.items()}
    expected = {v: lit(e[1]) for v, e in fixed.CHECK_EXPECTATIONS.items()}
    # an ERROR has a message but no metrics
    shown_actual = f"coalesce(if(status = 'FAIL', {_by_validation(actual, 'message')}, null), message)"
    return failed.selectExpr(
        *aliased(
            {
                "layer": "layer",
                "table": "`table`",
                "validation": "validation",
                "type": _by_validation(kinds, lit(fixed.DEFECT_GENERIC)),
                "severity": _by_validation(severities, "'Medium'"),
                "title": "concat(validation, ' failed')",
                "expected": _by_validation(expected, "'The validation passes.'"),
                "actual": shown_actual,
                "root_cause": f"coalesce({_by_validation(causes, 'null')}, {lit(fixed.ROOT_CAUSE_GENERIC)})",
                "fix": lit(fixed.FIX_GENERIC),
                "_seq": "seq",
                "_kind": "0",
                "_key": "cast(array() as array<string>)",
                "_part": "0",
            }
        )
    )


def run_cases(run: SuiteRun) -> list[CheckCase]:
    return [c for c in cases(run.pipeline) if (c.layer, c.table) in run.contexts]


def findings(run: SuiteRun, include_tolerated: bool = False) -> DataFrame:
    """Findings of a run, identical ones (same layer, table, type and actual text) once.

    If several checks compare a table, each reports its own findings. Order columns are kept for the tickets.
    """
    seq = {(c.layer, c.table, c.check): c.seq for c in run_cases(run)}
    parts = [check_findings(run), *_duplicate_findings(run)] if run.contexts else []
    for (layer, table), found in run.compared.items():
        for check in found:
            parts.append(comparison_findings(run, layer, table, check, include_tolerated, seq[layer, table, check]))
    if not parts:
        raise ValueError("no check ran")
    every = reduce(lambda a, b: a.unionByName(b), parts)
    signature = ["layer", "table", "type", "actual"]
    rest = [*_ORDER, *[c for c in FINDING_COLUMNS if c not in signature]]
    once = every.groupBy(*signature).agg(F.expr(f"min(struct({', '.join(rest)})) as first"))
    return once.select(*signature, "first.*").select(*FINDING_COLUMNS, *_ORDER)


def tickets(run: SuiteRun, include_tolerated: bool = False) -> DataFrame:
    """Defect tickets ``DEF_001, DEF_002, ...`` in check order, then by kind of finding and key."""
    numbered = number_rows(findings(run, include_tolerated), [*_ORDER, "actual"], "number")
    tests = {v: lit(e[2]) for v, e in fixed.CHECK_EXPECTATIONS.items()}
    steps = text(
        "1. Ensure the data is loaded/seeded for this scenario.\n2. Run `<v>` for <table> in <layer> (test `<test>`)."
        "\n3. Observe: <type>.",
        v="validation",
        table="`table`",
        layer="layer",
        test=_by_validation(tests, "validation"),
        type="type",
    )
    values = [
        "concat('DEF_', if(number < 1000, lpad(cast(number as string), 3, '0'), cast(number as string)))",
        "type",
        "severity",
        "layer",
        "`table`",
        "concat(layer, ' / ', `table`, ': ', title)",
        steps,
        "expected",
        "actual",
        "root_cause",
        "fix",
        "'New'",
    ]
    return numbered.selectExpr(*aliased(dict(zip(fixed.TICKET_COLUMNS, values))))
