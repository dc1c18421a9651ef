"""Find the keys worth a full comparison without moving full rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.normalize import TEXT, folded, key_value, kind_of
from tallymark.functions.text import all_of, names, quoted
from tallymark.operators.pairing import key_names, normalised_keys

SCREEN_LIMIT = 2_000_000
"""Most keys that are sent to every executor; beyond it the full comparison runs unscreened."""


def _fingerprint(
    rows: DataFrame, other: DataFrame, columns: Sequence[str], case_insensitive: bool, exact_decimals: bool, seed: int
) -> str:
    parts = []
    for c in columns:
        mine, theirs = rows.schema[c].dataType, other.schema[c].dataType
        value = key_value(quoted(c), mine, theirs)
        if exact_decimals and isinstance(mine, T.DecimalType) and isinstance(theirs, T.DecimalType):
            value = _exact(quoted(c), mine)
        if case_insensitive and kind_of(mine) == kind_of(theirs) == TEXT:
            value = folded(value)
        # the hash passes over NULLs, so their places are part of the input
        parts += [f"{value} is null", value]
    return f"xxhash64({', '.join([str(seed), *parts])})"


def _exact(value: str, dtype: T.DecimalType) -> str:
    """Text of a decimal that does not depend on its scale."""
    text = f"cast({value} as string)"
    return f"rtrim('.', rtrim('0', {text}))" if dtype.scale else text


def suspicious_keys(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    case_insensitive: bool = False,
    exact_decimals: bool = False,
) -> DataFrame:
    """Normalised keys that are not exactly once on each side with the same fingerprint of the compared columns.

    The shuffle carries the key, two counts and two 64-bit hashes for each side, all of fixed width, so the
    aggregate is a hash aggregate with map-side combine. Two rows that differ share both hashes with a probability
    of 2^-128; equal fingerprints therefore stand for equal rows. Values that are only equal within the number
    tolerance differ here and are decided by the full comparison.
    """
    normal = key_names(keys)
    tagged = []
    for side, rows, other in (("s", source, target), ("t", target, source)):
        hashes = [
            f"{_fingerprint(rows, other, columns, case_insensitive, exact_decimals, seed)} as {side}{seed}" for seed in (1, 2)
        ]
        tagged.append(rows.selectExpr(*normalised_keys(rows, keys, other), f"1L as {side}", *hashes))
    both = tagged[0].unionByName(tagged[1], allowMissingColumns=True)
    measures = ["count(s) as s", "count(t) as t", *[f"max({h}) as {h}" for h in ("s1", "s2", "t1", "t2")]]
    per_key = both.groupBy(*names(normal)).agg(*[F.expr(m) for m in measures])
    return per_key.where("not (s = 1 and t = 1 and s1 = t1 and s2 = t2)").select(*names(normal))


def keep_keys(rows: DataFrame, keys: Sequence[str], other: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose normalised key is among the (few) wanted ones: a map-side join, no shuffle."""
    keyed = rows.selectExpr("*", *normalised_keys(rows, keys, other)).alias("r")
    at = F.expr(all_of(f"r.{quoted(k)} <=> w.{quoted(k)}" for k in key_names(keys)))
    return keyed.join(F.broadcast(wanted).alias("w"), at, "left_semi").select(*names(rows.schema.names))
