"""Exact numbers of rows picked by hash, without a sort of the table."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import lit, quoted

_BITS, _STEP = 60, 12


def hash_place(keys: Sequence[str], seed: int = 0) -> str:
    """SQL: a number below 2^60 from the MD5 of the keys; it orders rows in a way that does not depend on the data layout."""
    parts = ", ".join(f"coalesce(cast({quoted(k)} as string), '')" for k in keys)
    return f"cast(conv(substring(md5(concat_ws('|', {parts}, {lit(str(seed))})), 1, 15), 16, 10) as bigint)"


def hash_thresholds(rows: DataFrame, keys: Sequence[str], ranks: Sequence[int], seed: int = 0) -> list[int]:
    """For each of ``ranks`` the value below which exactly so many rows have their :func:`hash_place`.

    Histograms of 4,096 bins are refined around all thresholds at once: five scans at most, each with a map-side count, and only bins
    reach the driver. A rank above the number of rows means all rows. Keys have to tell rows apart.
    """
    places = rows.selectExpr(f"{hash_place(keys, seed)} as place")
    found: dict[int, int] = {rank: 0 for rank in ranks if rank <= 0}
    search = {rank: (0, rank) for rank in ranks if rank > 0}  # start of the range, rows still wanted in it
    for shift in range(_BITS - _STEP, -1, -_STEP):
        if not search:
            break
        width = shift + _STEP
        ranges = sorted({low >> width for low, _ in search.values()})
        inside = places.where(F.shiftright("place", width).isin(ranges))
        bins = defaultdict(list)
        for row in inside.groupBy(F.shiftright("place", shift).alias("bin")).count().collect():
            bins[row["bin"] >> _STEP].append((row["bin"], row["count"]))
        for rank, (low, wanted) in list(search.items()):
            for at, n in sorted(bins[low >> width]):
                if wanted <= n:
                    break
                wanted -= n
            else:
                found[rank] = 1 << _BITS
                del search[rank]
                continue
            if wanted == n:
                found[rank] = (at + 1) << shift
                del search[rank]
            else:
                search[rank] = (at << shift, wanted)
    if search:
        raise ValueError(f"rows share the keys {list(keys)}; an exact number of them cannot be told apart by hash")
    return [found[rank] for rank in ranks]


def exact_sample(rows: DataFrame, keys: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """``k`` rows (all, if there are fewer), the same ones whenever the keys are the same."""
    (threshold,) = hash_thresholds(rows, keys, [k], seed)
    return rows.where(f"{hash_place(keys, seed)} < {threshold}")
