"""Outputs of runs kept from run to run.

Every output (results, summaries, failure records) is one table, partitioned by run and, where it has one, by layer. Recording a run again
replaces its own partitions and leaves all others alone, so a repeated run never doubles its rows; a layer that the repetition leaves out
stays as it was.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN, STARTED = "run", "run_started"


def record_run(outputs: Mapping[str, DataFrame], root: str, run: str, started: datetime) -> None:
    """Write each output of one run; ``started`` puts runs in order. Columns named ``run`` or ``run_started`` are refused."""
    at = F.lit(started.isoformat(sep=" ")).cast("timestamp_ntz")
    for name, df in outputs.items():
        if {RUN, STARTED} & set(df.columns):
            raise ValueError(f"output '{name}' has a column named {RUN} or {STARTED}")
        keys = [RUN, *(["layer"] if "layer" in df.columns else [])]
        rows = df.withColumns({STARTED: at, RUN: F.lit(run)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root.rstrip('/')}/{name}")


def history(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All recorded runs of an output. A run may have columns that earlier ones had not; a filter on run or layer prunes folders."""
    reader = spark.read.option("mergeSchema", "true")
    path = f"{root.rstrip('/')}/{name}"
    found = reader.parquet(path).schema
    texts = {RUN, "layer"}  # names of folders, which would else be read as numbers or dates where they look like some
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in texts else f for f in found.fields])
    return spark.read.schema(schema).parquet(path)


def check_history(results: DataFrame) -> DataFrame:
    """The status of each check in each run beside that in the run before it: ``change`` is new, fixed, broken, or the same status still."""
    return results.sparkSession.sql(
        """
        with h as (
          select run, run_started, layer, `table`, validation, status,
            lag(status) over (partition by layer, `table`, validation order by run_started, run) as previous from {results})
        select *, case when previous is null then 'new'
            when status in ('FAIL', 'ERROR') and previous not in ('FAIL', 'ERROR') then 'broken'
            when status not in ('FAIL', 'ERROR') and previous in ('FAIL', 'ERROR') then 'fixed'
            when status <> previous then 'changed' else 'same' end as change
        from h
        """,
        results=results,
    )
