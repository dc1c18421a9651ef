"""Summaries of check results."""

from __future__ import annotations

from pyspark.sql import DataFrame

_FAILED = "status in ('FAIL', 'ERROR')"
_SKIPPED = "status = 'SKIP'"
_PASSED = f"not ({_FAILED}) and not ({_SKIPPED})"


def failures(results: DataFrame) -> DataFrame:
    return results.where(_FAILED)


def skipped(results: DataFrame) -> DataFrame:
    return results.where(_SKIPPED)


def executed(results: DataFrame) -> DataFrame:
    return results.where(f"not ({_SKIPPED})")


def ordered_results(results: DataFrame) -> DataFrame:
    """Executed checks first, then the skipped ones, each in catalogue order (``seq``).

    There is one row for each configured check, so one partition holds them and no ranges have to be sampled.
    """
    ranked = results.selectExpr("*", f"{_SKIPPED} as _last").repartition(1)
    return ranked.sortWithinPartitions("_last", "seq").drop("_last")


def summary_counts(results: DataFrame) -> DataFrame:
    """Run totals, the pass rate over the executed checks, and the verdict."""
    counts = results.selectExpr(
        "count(1) as total",
        f"count_if({_PASSED}) as passed",
        f"count_if({_FAILED}) as failed",
        f"count_if({_SKIPPED}) as skipped",
    )
    return counts.selectExpr(
        "*",
        "passed + failed as executed",
        "if(passed + failed > 0, round(passed / (passed + failed) * 100, 2), 0D) as pass_rate",
        "if(failed = 0, 'PASSED', 'FAILED') as verdict",
    )


def summary_by_layer(results: DataFrame) -> DataFrame:
    flags = results.selectExpr("layer", f"{_PASSED} as p", f"{_FAILED} as f", f"{_SKIPPED} as s")
    grouped = flags.groupBy("layer")
    return grouped.agg({"p": "count_if", "f": "count_if", "s": "count_if"}).selectExpr(
        "layer", "`count_if(p)` as passed", "`count_if(f)` as failed", "`count_if(s)` as skipped"
    )


def run_totals(results: DataFrame) -> DataFrame:
    """Totals of an execution: checks that could not run (ERROR) count as failed; durations are added up."""
    totals = results.selectExpr(
        "count(1) as total",
        f"count_if({_FAILED}) as failed",
        "count_if(status = 'ERROR') as errors",
        f"count_if({_SKIPPED}) as skipped",
        "coalesce(sum(duration), 0D) as duration",
    )
    return totals.selectExpr(
        "total", "greatest(0L, total - failed - skipped) as passed", "failed", "errors", "skipped", "duration"
    )
