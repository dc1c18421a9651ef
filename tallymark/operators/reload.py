"""Full reload of all layers: level by level, published as a whole, resumed where it broke.

The load of one table is a stage. A stage needs its source table and, in its own layer, the tables it looks keys up in or refers to; stages
whose needs are met run at once. Every stage writes into a folder of its own run and then one row into the journal of the run. Nothing
of an earlier run is touched, so readers of the published tables see either the earlier or the new run, never a mixture:

    <root>/<database>/<schema>/<table>/<run>      rows of a stage
    <root>/reload-journal/<run>/<database>/...    one row for each finished stage
    <root>/reload-published/<run>                 all rows of the journal, written when every stage is done: the commit marker

A run that broke is started again under its name: stages in the journal are kept, the broken one is written anew. All folders are reached
through Spark's readers and writers alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.loads import load_stage
from tallymark.sources.literal import literal_rows
from tallymark.sources.tables import TableStore
from tallymark.spec import LayerSpec, PipelineSpec, TableSpec, table_path

STAGES_AT_ONCE = 4
JOURNAL = {
    "run": "string", "level": "int", "database": "string", "table": "string", "path": "string", "row_count": "bigint", "written_at": "timestamp"
}
_JOURNAL_SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in JOURNAL.items())


class ReloadBroken(RuntimeError):
    """A stage failed; the stages in the journal of the run are kept."""


@dataclass(frozen=True)
class Stage:
    layer: LayerSpec
    table: TableSpec

    @property
    def output(self) -> tuple[str, str]:
        return self.layer.target_db, self.table.target_table

    def inputs(self, references: bool = True) -> set[tuple[str, str]]:
        """Tables that must be there first; ``references`` includes those of foreign keys."""
        inside = [s.ref_table for s in self.table.lookups]
        inside += [k.ref_table for k in self.table.foreign_keys] if references else []
        return {(self.layer.source_db, self.table.source_table), *((self.layer.target_db, t) for t in inside)} - {self.output}


def stage_levels(pipeline: PipelineSpec) -> list[list[Stage]]:
    """All stages in levels; the needs of a stage lie in levels before its own.

    Foreign keys only order the loads, so a cycle of them is broken; a cycle of lookups cannot be loaded.
    """
    waiting = [Stage(layer, table) for layer in pipeline.layers.values() for table in layer.tables.values()]
    levels: list[list[Stage]] = []
    while waiting:
        open_outputs = {s.output for s in waiting}
        ready = [s for s in waiting if not s.inputs() & open_outputs]
        ready = ready or [s for s in waiting if not s.inputs(references=False) & open_outputs]
        if not ready:
            raise ValueError(f"these tables need each other: {sorted(open_outputs)}")
        levels.append(ready)
        waiting = [s for s in waiting if s not in ready]
    return levels


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    reader = spark.read.schema(_JOURNAL_SCHEMA).option("recursiveFileLookup", "true")
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def journal(spark: SparkSession, root: str, run: str) -> DataFrame | None:
    """One row for each finished stage of a run; None if there is none."""
    return _read_if_there(spark, f"{root.rstrip('/')}/reload-journal/{run}")


def published(spark: SparkSession, root: str, run: str | None = None) -> TableStore | None:
    """The tables of the last published run, or of the given one; None if it has not been published."""
    rows = _read_if_there(spark, f"{root.rstrip('/')}/reload-published")
    if rows is None:
        return None
    chosen = rows.where(F.col("run") == run) if run else rows.join(rows.agg(F.max_by("run", "written_at").alias("run")), "run")
    found = chosen.select("database", "table", "path").collect()  # one row for each table
    if not found:
        return None
    store = TableStore(spark)
    for row in found:
        store.register(row["database"], row["table"], spark.read.parquet(row["path"]))
    return store


def reload_all(
    spark: SparkSession,
    pipeline: PipelineSpec,
    sources: Mapping[str, DataFrame],
    root: str,
    run: str,
    effective: datetime,
    previous: TableStore | None = None,
) -> TableStore:
    """Reload every layer from ``sources`` (source table name to rows of the first layer), publish the result and return its tables.

    ``run`` names this reload and its inputs: called again after a failure, it goes on with the stages that are not in the journal; called
    again after success, it only returns the tables. ``previous`` supplies the dimensions of the last load, for example
    ``published(spark, root)``; without it dimensions start empty, which is a full reset. A failed stage raises ``ReloadBroken`` after
    the other stages of its level have ended.
    """
    root = root.rstrip("/")
    done = published(spark, root, run)
    if done is not None:
        return done
    found = journal(spark, root, run)
    finished = {(r["database"], r["table"]): r["path"] for r in found.collect()} if found is not None else {}
    store = TableStore(spark)
    for name, df in sources.items():
        store.register(next(iter(pipeline.layers.values())).source_db, name, df)

    def run_stage(level: int, stage: Stage) -> None:
        database, table = stage.output
        path = finished.get(stage.output)
        if path is None:
            path = f"{root}/{database}/{table_path(table)}/{run}"
            counted = Observation()
            rows = load_stage(store, previous, stage.layer, stage.table, effective)
            rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
            row = (run, level, database, table, path, counted.get["rows"], datetime.now(timezone.utc).isoformat())
            literal_rows(spark, JOURNAL, [row]).write.mode("overwrite").parquet(
                f"{root}/reload-journal/{run}/{database}/{table_path(table)}"
            )
        store.register(database, table, spark.read.parquet(path))

    for level, stages in enumerate(stage_levels(pipeline)):
        with ThreadPoolExecutor(STAGES_AT_ONCE) as pool:
            started = [(stage, pool.submit(run_stage, level, stage)) for stage in stages]
        for stage, outcome in started:
            problem = outcome.exception()
            if problem is not None:
                reason = next((line for line in str(problem).splitlines() if line.strip()), type(problem).__name__)
                raise ReloadBroken(f"{'.'.join(stage.output)}: {reason}") from problem
    finished_rows = journal(spark, root, run)
    if finished_rows is not None:
        finished_rows.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(
            f"{root}/reload-published/{run}"
        )
    return store


def reload_gate(
    store: TableStore,
    pipeline: PipelineSpec,
    sources: Mapping[str, DataFrame],
    root: str,
    run: str,
    effective: datetime,
    previous: TableStore | None = None,
) -> Callable[[], tuple[bool, str]]:
    """The reload as prerequisite of a suite run: on success its tables are registered in ``store``, which the checks then read."""

    def gate() -> tuple[bool, str]:
        try:
            loaded = reload_all(store.spark, pipeline, sources, root, run, effective, previous)
        except ReloadBroken as broken:
            return False, f"reload stopped at {broken}"
        for name, df in sources.items():
            store.register(next(iter(pipeline.layers.values())).source_db, name, df)
        stages = [stage for level in stage_levels(pipeline) for stage in level]
        for stage in stages:
            store.register(*stage.output, loaded.table(*stage.output))
        return True, f"{len(stages)} tables reloaded"

    return gate
