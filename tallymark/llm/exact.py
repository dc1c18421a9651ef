"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Two texts are equal if they are identical without white space (``[\\x20\\x09-\\x0D]``). Each step only looks at what the step before could not
tell apart:

1. one scan notes the length of every normalised text and hashes its first characters;
2. lengths that occur once are done; of the others, so are pairs (length, prefix hash) that occur once;
3. a second scan hashes whole texts (SHA-256), but only those of pairs that are left, and groups them.

The texts themselves are never shuffled: pairs that are left are broadcast if they are light; if not, the second scan hashes every text and
sorts out the rows afterwards. Groups with very many rows are joined back from a broadcast list of bounded length, all others by a
shuffle of narrow rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialised

from .common import BROADCAST_BYTES, broadcast_if_light, measured_bytes

PREFIX_CHARACTERS = 64
HOT_ROWS = 10_000
HOT_GROUPS = 100_000
"""A group is hot above ``HOT_ROWS`` rows and above rows / ``HOT_GROUPS``; so there are at most ``HOT_GROUPS`` hot ones (10 MB)."""


def normalised(text: Column | str = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_duplicates(documents: DataFrame, also: Mapping[str, Column] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept for each row of ``documents`` (doc_id, text), dropped ones too.

    Of equal texts the row with the most code points in its original text stays, then the smallest doc_id (null last), then any one of
    rows that repeat each other. Null and empty texts, and those of white space only, are equal to each other. An empty table gives no
    rows. Other columns are ignored, except through ``also``: expressions over the columns of ``documents`` that are computed
    in the second scan and returned beside the result.
    """
    also = dict(also or {})
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("__text"),
        F.length(F.coalesce("text", F.lit(""))).alias("__points"), *[c.alias(name) for name, c in also.items()],
    ).select(
        "*", F.octet_length("__text").alias("__length"), F.xxhash64(F.substring("__text", 1, PREFIX_CHARACTERS)).alias("__prefix")
    )
    by_prefix = materialised(rows.groupBy("__length", "__prefix").agg(F.count(F.lit(1)).alias("__n")), "prefixes")
    repeated = by_prefix.groupBy("__length").agg(F.sum("__n").alias("__m")).where("__m > 1").select("__length")
    open_pairs = by_prefix.where("__n > 1").join(broadcast_if_light(repeated), "__length", "left_semi").select("__length", "__prefix")
    pair, digest = ["__length", "__prefix"], F.unhex(F.sha2("__text", 256)).alias("__hash")
    own = ["doc_id", "__points", *also]
    if measured_bytes(open_pairs) <= BROADCAST_BYTES:
        marked = rows.join(open_pairs.withColumn("__open", F.lit(True)).hint("broadcast"), pair, "left")
        found = marked.select(*own, "__length", F.when(F.col("__open"), digest).alias("__hash"))
    else:
        marked = rows.select(*own, *pair, digest).join(open_pairs.withColumn("__open", F.lit(True)).hint("merge"), pair, "left")
        found = marked.select(*own, "__length", F.when(F.col("__open"), F.col("__hash")).alias("__hash"))
    hashed = materialised(found.withColumn("__row", F.monotonically_increasing_id()), "hashed")
    order = F.struct(
        (-F.col("__points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("__row").alias("row")
    )
    groups = materialised(
        hashed.where("__hash is not null").groupBy("__length", "__hash")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("__size"))
        .where("__size > 1")
        .select("__length", "__hash", F.col("first.doc_id").alias("__keep"), F.col("first.row").alias("__kept_row"), "__size"),
        "groups",
    )
    total = hashed.count()
    is_hot = F.col("__size") > max(hot_rows, total // HOT_GROUPS)
    key = ["__length", "__hash"]
    of_hot = hashed.join(groups.where(is_hot).hint("broadcast"), key, "left")
    parts = [
        of_hot.where("__hash is null or __size is not null"),
        of_hot.where("__hash is not null and __size is null").drop("__keep", "__kept_row", "__size")
        .join(groups.where(~is_hot).hint("merge"), key, "left"),
    ]
    alone = F.col("__size").isNull()
    return parts[0].unionByName(parts[1]).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("__row") == F.col("__kept_row"))).alias("kept"),
        *also,
    )
