"""Run the checks of a pipeline."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from tallymark import fixed_values as fixed
from tallymark.operators.compare import Comparison
from tallymark.plans import checks
from tallymark.plans.catalogue import CheckCase, cases
from tallymark.plans.checks import RESULT_SCHEMA, RESULT_TYPES, CheckContext, check_results
from tallymark.plans.observed import ObservedStore
from tallymark.session import HOT_KEY_ROWS
from tallymark.sources.literal import literal_rows
from tallymark.sources.tables import TableStore
from tallymark.spec import PipelineSpec

JOBS_AT_ONCE = 4
Gate = Callable[[], tuple[bool, str]]


@dataclass
class SuiteRun:
    """Results of a run (``seq`` is the catalogue order) and the comparisons behind them."""

    pipeline: PipelineSpec
    results: DataFrame
    contexts: dict[tuple[str, str], CheckContext] = field(default_factory=dict)
    compared: dict[tuple[str, str], list[str]] = field(default_factory=dict)  # the checks that compared a table

    failed: set[tuple[str, str, str]] = field(default_factory=set)  # (layer, table, check) with status FAIL
    measured: list[tuple[str, str, str, float, int | None]] = field(default_factory=list)
    """Of a timed run: layer, table, check, seconds, and the rows it read."""

    def comparison(self, layer: str, table: str, check: str) -> Comparison:
        return self.contexts[layer, table].comparison(check)

    def volumes(self, spark: SparkSession) -> DataFrame:
        """One row for each check of a timed run: layer, table, validation, seconds, rows_read (after filters, before any aggregate)."""
        kinds = {"layer": "string", "table": "string", "validation": "string", "seconds": "double", "rows_read": "bigint"}
        return literal_rows(spark, kinds, self.measured)

    def comparisons(self) -> dict[tuple[str, str, str], Comparison]:
        return {(*at, check): self.comparison(*at, check) for at, found in self.compared.items() for check in found}


def _fixed_rows(store: TableStore, items: Sequence[tuple[CheckCase, str, str, str]]) -> DataFrame:
    """Result rows that need no data: skipped checks and checks that cannot be planned."""
    rows = [
        (None, c.layer, c.table, c.check, category, status, text, None, None, None, None, c.seq)
        for c, category, status, text in items
    ]
    built = literal_rows(store.spark, RESULT_TYPES, rows)
    return built.drop("timestamp").selectExpr("current_timestamp() as timestamp", "*")


@dataclass
class _TableJob:
    """The checks of one table as one plan, and what could not be planned."""

    ctx: CheckContext
    items: list[CheckCase]
    plan: DataFrame | None = None
    problems: list[tuple[CheckCase, str]] = field(default_factory=list)

    def run(self) -> list[dict]:
        """Result rows (one for each check). If the plan fails while it runs, its checks run one by one.

        The checks share one job, so its time belongs to none of them alone: the first row carries it, the others have no duration.
        """
        started = time.perf_counter()
        try:
            rows = self.plan.collect() if self.plan is not None else []
        except Exception:
            rows = []
            for c in self.items:
                try:
                    rows += check_results(self.ctx, [c.check], [c.seq]).collect()
                except Exception as problem:
                    self.problems.append((c, _reason(problem)))
        seconds = time.perf_counter() - started
        return [{**row.asDict(), "duration": None if i else seconds} for i, row in enumerate(rows)]

    def run_each(self) -> tuple[list[dict], list[tuple[str, str, str, float, int | None]]]:
        """Every check as a job of its own: result rows with its time, and what it read."""
        rows, volumes = [], []
        for c in self.items:
            store = ObservedStore(self.ctx.store)
            own = replace(self.ctx, store=store, _comparisons={})
            started = time.perf_counter()
            try:
                found = check_results(own, [c.check], [c.seq]).collect()
            except Exception as problem:
                self.problems.append((c, _reason(problem)))
                continue
            seconds = time.perf_counter() - started
            rows += [{**row.asDict(), "duration": seconds} for row in found]
            volumes.append((c.layer, c.table, c.check, seconds, store.rows_read()))
            self.ctx.adopt(own)
        return rows, volumes


def _reason(problem: Exception) -> str:
    return next((line for line in str(problem).splitlines() if line.strip()), type(problem).__name__)


def _plan_table(ctx: CheckContext, items: list[CheckCase]) -> _TableJob:
    """All checks of a table as one plan; a check that cannot be planned, whatever the reason, is kept apart."""

    def planned(some: list[CheckCase]) -> DataFrame | None:
        return check_results(ctx, [c.check for c in some], [c.seq for c in some]) if some else None

    try:
        return _TableJob(ctx, items, planned(items))
    except Exception:
        job = _TableJob(ctx, [])
    for c in items:
        try:
            check_results(ctx, [c.check])
            job.items.append(c)
        except Exception as problem:
            job.problems.append((c, _reason(problem)))
    job.plan = planned(job.items)
    return job


def run_suite(
    store: TableStore,
    pipeline: PipelineSpec,
    only: Sequence[str] | None = None,
    gate: Gate | None = None,
    hot_rows: int = HOT_KEY_ROWS,
    keep_issues: bool = False,
    timed: bool = False,
) -> SuiteRun:
    """Run every check of the pipeline.

    ``only``: tags to run; the other checks stay in the results as SKIP. ``gate``: prerequisite, called first
    whatever the selection; when it fails, every other check is skipped and no job is started.

    Every table is one job of its own, a few at a time; its handful of result rows is gathered. A check that cannot be
    planned or that fails while it runs becomes an ERROR row and costs no other result.

    ``keep_issues``: every comparison writes its problem rows to shared storage, once; its verdict and all failure records, findings
    and tickets of this run are taken from there.

    ``timed``: every check is a job of its own, with its own duration and the number of rows it read (``SuiteRun.volumes``). Tables are
    then read once for each check; otherwise the checks of a table share their scans and only the table has a duration.
    """
    listed = cases(pipeline)
    outputs: list[DataFrame] = []
    run = SuiteRun(pipeline, _fixed_rows(store, []))

    if gate is not None:
        try:
            passed, text = gate()
        except Exception as problem:  # whatever stopped the prerequisite must skip the rest, not the report
            passed, text = False, str(problem)
        case = CheckCase(-1, "Prerequisite", "ALL", fixed.GATE_CHECK, ())
        outputs.append(_fixed_rows(store, [(case, "prerequisite", "PASS" if passed else "FAIL", text)]))
        if not passed:
            outputs.append(_fixed_rows(store, [(c, "skipped", "SKIP", fixed.SKIPPED_BY_GATE) for c in listed]))
            run.results = _union(outputs)
            return run

    if only:
        reason = fixed.SKIPPED_BY_SELECTION.format(only=" or ".join(only))
        dropped = [(c, "skipped", "SKIP", reason) for c in listed if not set(only) & set(c.tags)]
        listed = [c for c in listed if set(only) & set(c.tags)]
        if dropped:
            outputs.append(_fixed_rows(store, dropped))

    tables = []
    for at, group in groupby(listed, key=lambda c: (c.layer, c.table)):
        ctx = CheckContext(store, pipeline.layer(at[0]), pipeline.table(*at), hot_rows, keep_issues=keep_issues)
        tables.append((ctx, list(group)))
        run.contexts[at] = ctx

    def judged(table: tuple[CheckContext, list[CheckCase]]) -> tuple[_TableJob, list[dict]]:
        if timed:
            job = _TableJob(*table)
            rows, volumes = job.run_each()
            run.measured.extend(volumes)
            return job, rows
        job = _plan_table(*table)
        return job, job.run()

    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        done = list(pool.map(judged, tables))
    jobs, measured = [job for job, _ in done], [row for _, rows in done for row in rows]
    if measured:
        outputs.append(store.spark.createDataFrame(measured, RESULT_SCHEMA))
    errors = [(c, checks.CATEGORIES.get(c.check, "basic"), "ERROR", text) for job in jobs for c, text in job.problems]
    if errors:
        outputs.append(_fixed_rows(store, errors))
    status = {(row["layer"], row["table"], row["validation"]): row["status"] for row in measured}
    for at, ctx in run.contexts.items():
        usable = [check for check in ctx.comparisons() if (*at, check) in status]
        if usable:
            run.compared[at] = usable
    run.failed = {at for at, found in status.items() if found == "FAIL"}

    if outputs:
        run.results = _union(outputs)
    return run


def _union(outputs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), outputs)
