"""Keyed comparison of a source and a target table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from tallymark.functions.normalize import as_text, values_equal
from tallymark.functions.text import aliased, all_of, case, field, lit, names, quoted
from tallymark.operators.duplicates import duplicate_rows
from tallymark.operators.pairing import key_names, pair_by_key
from tallymark.operators.screening import SCREEN_LIMIT, keep_keys, suspicious_keys
from tallymark.session import HOT_KEY_ROWS, materialised

BOTH, SOURCE_ONLY, TARGET_ONLY = "both", "source_only", "target_only"


class Comparison:
    """Lazy outcome of a comparison; every part is a DataFrame of its own.

    All parts but ``duplicates`` derive from one aggregate over both tables (see :func:`pair_by_key`). When several
    parts are wanted, :meth:`keep` writes the keys with a problem, not the matching rows, to shared storage.
    """

    def __init__(
        self,
        source: DataFrame,
        target: DataFrame,
        keys: Sequence[str],
        compare_columns: Sequence[str],
        case_insensitive: bool = False,
        exact_decimals: bool = False,
        hot_rows: int = HOT_KEY_ROWS,
    ) -> None:
        self.source, self.target = source, target
        self.keys = list(keys)
        self.columns = source.schema.names
        self.target_columns = target.schema.names
        self.compare_columns = [c for c in compare_columns if c in self.columns and c in self.target_columns]
        self.case_insensitive = case_insensitive
        self.exact_decimals = exact_decimals
        self.hot_rows = hot_rows
        self._kept: DataFrame | None = None
        self._suspects: tuple[DataFrame, DataFrame] | None = None

    def screen(self, limit: int = SCREEN_LIMIT) -> Comparison:
        """Narrow the work down to suspicious keys first; for large, wide tables with few differences.

        A first job shuffles fingerprints instead of rows (see :mod:`screening`) and writes the suspicious keys to
        shared storage. If there are at most ``limit`` of them, all details come from the rows of those keys, which
        are picked in a map-side join; otherwise the comparison goes on with all rows. The outcome is the same.
        """
        found = suspicious_keys(
            self.source, self.target, self.keys, self.compare_columns, self.case_insensitive, self.exact_decimals
        )
        found = materialised(found, "suspects")
        if found.count() <= limit:
            self._suspects = (
                keep_keys(self.source, self.keys, self.target, found),
                keep_keys(self.target, self.keys, self.source, found),
            )
            self.__dict__.pop("_issues", None)
        return self

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        return self._suspects or (self.source, self.target)

    def _equal(self, column: str) -> str:
        return values_equal(
            field("source_row", column),
            self.source.schema[column].dataType,
            field("target_row", column),
            self.target.schema[column].dataType,
            self.case_insensitive,
            self.exact_decimals,
        )

    @property
    def paired(self) -> DataFrame:
        """Every key of either side: its copies, its first rows, its state, whether the key is duplicated."""
        return self._pair(self.source, self.target)

    def _pair(self, source: DataFrame, target: DataFrame) -> DataFrame:
        return self._with_state(pair_by_key(source, target, self.keys, self.compare_columns))

    def _with_state(self, paired: DataFrame) -> DataFrame:
        state = case([("n_target = 0", lit(SOURCE_ONLY)), ("n_source = 0", lit(TARGET_ONLY))], lit(BOTH))
        has_key = all_of(f"{quoted(name)} is not null" for name in key_names(self.keys))
        return paired.selectExpr(
            "*", f"{state} as state", f"({has_key}) and (n_source > 1 or n_target > 1) as is_duplicate"
        )

    @cached_property
    def _issues(self) -> DataFrame:
        # One mark for each compared column, '1' where it differs. The tests are written out once, as arguments of one
        # function: long chains of AND, OR or + over them would cost the optimizer far more than the job itself.
        tests = ", ".join(f"if({self._equal(c)}, '0', '1')" for c in self.compare_columns)
        marks = f"if(state = '{BOTH}', concat({tests}), '')" if tests else "''"
        marked = self._pair(*self._sides()).selectExpr("*", f"{marks} as _marks")
        found = marked.where(f"state != '{BOTH}' or is_duplicate or contains(_marks, '1')")
        named = ", ".join(
            f"if(substring(_marks, {i}, 1) = '1', {lit(c)}, null)" for i, c in enumerate(self.compare_columns, start=1)
        )
        return found.selectExpr(
            *[quoted(n) for n in marked.schema.names if n != "_marks"],
            "cast(length(replace(_marks, '0', '')) as bigint) as n_diffs",
            f"array_compact(array({named or 'cast(null as string)'})) as diff_columns",
        )

    @property
    def issues(self) -> DataFrame:
        """The keys with at least one problem, with the number and the list of differing columns.

        Matching keys are dropped by plain boolean tests inside code generation; the list is built for the others.
        """
        return self._issues if self._kept is None else self._kept

    def keep(self) -> Comparison:
        """Run the comparison now, once; verdict and reports read the problem rows it wrote. Nothing is cached in the session."""
        if self._kept is None:
            self._kept = materialised(self._issues, "issues")
        return self

    def keyed_states(self) -> DataFrame:
        """Normalised key, copies on each side, and whether the key is on both sides or on one."""
        renamed = {k: quoted(name) for name, k in zip(key_names(self.keys), self.keys)}
        return self.paired.selectExpr(*aliased(renamed), "n_source", "n_target", "state")

    def _cell(self, row: str, frame: DataFrame) -> str:
        """Text of the value named by ``column``."""
        return case(
            [(f"column = {lit(c)}", as_text(field(row, c), frame.schema[c].dataType)) for c in self.compare_columns]
        )

    def diffs(self) -> DataFrame:
        """One row for each differing cell: key columns, column, source and target value as text."""
        cells = self.issues.where("n_diffs > 0").selectExpr(
            "source_row", "target_row", "explode(diff_columns) as column"
        )
        return cells.selectExpr(
            *aliased({k: field("source_row", k) for k in self.keys}),
            "column",
            f"{self._cell('source_row', self.source)} as source_value",
            f"{self._cell('target_row', self.target)} as target_value",
        )

    def diff_pairs(self) -> DataFrame:
        """One row for each differing record: the differing columns and both full rows."""

        def row(side: str, columns: Sequence[str]) -> str:
            parts = ", ".join(f"{lit(c)}, {field(f'{side}_row', c)}" for c in columns)
            return f"named_struct({parts}) as {side}_row"

        return self.issues.where("n_diffs > 0").selectExpr(
            "diff_columns", row("source", self.columns), row("target", self.target_columns)
        )

    def missing_in_target(self) -> DataFrame:
        """Full source rows (one for each key) without a target row."""
        rows = self.issues.where(f"state = '{SOURCE_ONLY}'")
        return rows.selectExpr(*aliased({c: field("source_row", c) for c in self.columns}))

    def missing_in_source(self) -> DataFrame:
        """Full target rows (one for each key) without a source row."""
        rows = self.issues.where(f"state = '{TARGET_ONLY}'")
        return rows.selectExpr(*aliased({c: field("target_row", c) for c in self.target_columns}))

    def duplicates_on(self, side: str) -> DataFrame:
        source, target = self._sides()
        rows, other = (source, target) if side == "source" else (target, source)
        return duplicate_rows(rows, self.keys, other, self.hot_rows).selectExpr("*", f"'{side}' as _side")

    def duplicates(self) -> DataFrame:
        """All rows of all duplicated keys on either side, with ``_side`` and ``_copies``."""
        return self.duplicates_on("source").unionByName(self.duplicates_on("target"), allowMissingColumns=True)

    def _narrowed(self, columns: Sequence[str]) -> Comparison:
        """The same comparison over some of the columns."""
        source, target = (df.select(*names(columns)) for df in (self.source, self.target))
        return type(self)(
            source, target, self.keys, self.compare_columns, self.case_insensitive, self.exact_decimals, self.hot_rows
        )

    def summary(self) -> DataFrame:
        """One row: differing cells and records, missing rows both ways, duplicate rows, and the verdict.

        The verdict needs keys and compared columns only, so other columns are neither scanned nor shuffled for it.
        """
        needed = dict.fromkeys([*self.keys, *self.compare_columns])
        if self._kept is None and self._suspects is None and {*self.columns, *self.target_columns} - needed.keys():
            return self._narrowed(list(needed)).summary()
        copies = "if(n_source > 1, n_source, 0L) + if(n_target > 1, n_target, 0L)"
        counts = self.issues.selectExpr(
            "coalesce(sum(n_diffs), 0) as diffs",
            "count_if(n_diffs > 0) as differing_rows",
            f"count_if(state = '{SOURCE_ONLY}') as missing_in_target",
            f"count_if(state = '{TARGET_ONLY}') as missing_in_source",
            f"coalesce(sum(if(is_duplicate, {copies}, 0L)), 0) as duplicates",
        )
        return counts.selectExpr("*", "diffs + missing_in_target + missing_in_source + duplicates = 0 as is_match")


def compare(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    compare_columns: Sequence[str],
    case_insensitive: bool = False,
    exact_decimals: bool = False,
    hot_rows: int = HOT_KEY_ROWS,
) -> Comparison:
    """Compare two tables by business key; columns absent from either side are left out."""
    return Comparison(source, target, keys, compare_columns, case_insensitive, exact_decimals, hot_rows)
