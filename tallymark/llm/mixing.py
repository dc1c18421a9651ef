"""Mixing sources to target weights by pivotal dependent rounding.

A document is to be taken ``target / source_size`` times, which is a whole number of copies and a fraction. Fractions are
rounded pair by pair: mass (fraction times words) moves at random from one document to the other until one of the two
fractions is 0 or 1, so the expected copies stay as asked for and the words of the pair stay as they were. Each block of
documents leaves one fraction at most; these residuals meet in a reduction tree of blocks until each source has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import materialised

from .common import broadcast_if_small

DOCUMENTS_IN_BLOCK = 8_192
RESIDUALS_IN_BLOCK = 1_024
WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-12


def word_count(text) -> F.Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """``source``, ``source_size`` with the ``target`` of each source: the total shared by weight, at most ``limit`` x its size.

    Sources are taken in code point order, null last, and weigh ``weights`` in turn. What is above a source's limit is shared anew by
    weight among the others, until none is above. In order of (limit / weight) the sources above are a prefix, so one running
    sum finds them. One row for each source goes through this window, never one for each document.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.sparkSession.sql(
        "select *, row_number() over (order by encode(source, 'UTF-8') nulls last) - 1 as __place from {sources}",
        sources=sources.select("source", "source_size"),
    ).withColumn("__weight", F.element_at(cycle, (F.col("__place") % len(weights) + 1).cast("int")))
    return ranked.sparkSession.sql(
        f"""
        with ordered as (
          select *, {limit}D * source_size as cap,
            row_number() over (order by {limit}D * source_size / __weight, __place) as turn,
            sum(source_size) over () - coalesce(sum({limit}D * source_size) over earlier, 0) as left_size,
            sum(__weight) over () - coalesce(sum(__weight) over earlier, 0) as left_weight
          from {{ranked}}
          window earlier as (order by {limit}D * source_size / __weight, __place
                             rows between unbounded preceding and 1 preceding)),
        levels as (
          select *, min_by(left_size / left_weight, case when left_size / left_weight * __weight <= cap then turn end) over () as level
          from ordered)
        select source, source_size, coalesce(least(cap, level * __weight), cap) as target from levels
        """,
        ranked=ranked
    )


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> int:
    """Round ``p`` in place; returns the place of the fraction that is left, or -1.

    ``size`` (positive) is what one unit of ``p`` weighs; ``sum(p * size)`` does not change. ``draw`` are uniform numbers.
    """
    held = -1
    for i in range(len(p)):
        if p[i] <= _NEAR or p[i] >= 1 - _NEAR:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # mass that can move from b to a
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        moved = up if draw[i] * (up + down) < down else -down
        p[a] += moved / size[a]
        p[b] -= moved / size[b]
        fractions = [j for j in (a, b) if _NEAR < p[j] < 1 - _NEAR]
        for j in (a, b):
            if j not in fractions:
                p[j] = round(p[j])
        held = fractions[0] if fractions else -1
    return held


def _draws(seed: int, key: tuple, n: int) -> np.ndarray:
    digest = hashlib.sha256(repr((seed, *key)).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "big"))).random(n)


def _round_documents(seed: int):
    def work(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["__mix", "size", "doc_id"], kind="stable").reset_index(drop=True)
        p = block["__p"].to_numpy(float).copy()
        size = block["size"].to_numpy(float)
        held = pivot(p, size, _draws(seed, (0, int(block["__place"][0]), int(block["__block"][0])), len(p)))
        block["__residual"] = np.where(np.arange(len(p)) == held, p, np.nan)
        block["__taken"] = np.where(np.arange(len(p)) == held, 0, np.round(p)).astype("int64")
        return block[["doc_id", "size", "__place", "__block", "__whole", "__taken", "__residual"]]

    return work


def _round_residuals(seed: int, level: int):
    """Rows are the residuals (or groups of them) below one node of the tree; one fraction is left at most."""

    def work(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("__block", kind="stable").reset_index(drop=True)
        p = block["__p"].to_numpy(float).copy()
        held = pivot(p, block["size"].to_numpy(float), _draws(seed, (level, int(block["__place"][0]), int(block["__node"][0])), len(p)))
        block["__p"] = p
        block["__open"] = np.arange(len(p)) == held
        return block[["__place", "__block", "__node", "size", "__p", "__open"]]

    return work


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, copies, taken.

    One row for each input row (repeated rows are rounded one by one). A null text and a text without words have size 0 and are taken
    0 times; if a source has no words its target is 0. An empty table gives no rows. The words taken from a source
    differ from its target by less than one document. Results depend on the rows and ``seed`` only, not on partitions or executors:
    blocks are formed by hashes of doc_id, and rows of a block that agree in all columns are interchangeable. Other columns are ignored.
    """
    spark = documents.sparkSession
    sized = materialised(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "mixing"
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("__n"))
    targets = source_targets(sources, weights, limit).withColumnRenamed("source", "__source")
    plan = materialised(
        targets.join(sources.select("source", "__n"), F.col("__source").eqNullSafe(F.col("source")))
        .select("source", "source_size", "target", "__n")
        .withColumn("__place", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))),
        "mixing",
    )
    per_source = plan.withColumnRenamed("source", "__source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(broadcast_if_small(per_source), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("__n") / DOCUMENTS_IN_BLOCK))
    mixed = F.xxhash64("doc_id", F.lit(seed))
    planned = rows.select(
        "doc_id",
        "size",
        "__place",
        mixed.alias("__mix"),
        F.pmod(mixed, blocks).alias("__block"),
        F.floor(share).alias("__whole"),
        (share - F.floor(share)).alias("__p"),
    )
    first = materialised(
        planned.where("size > 0")
        .groupBy("__place", "__block")
        .applyInPandas(
            _round_documents(seed),
            "doc_id long, size long, __place long, __block long, __whole long, __taken long, __residual double",
        ),
        "mixing",
    )
    level, closed = 1, []
    open_rows = first.where("__residual is not null").selectExpr("__place", "__block", "__block as __node", "size", "__residual as __p")
    most = plan.agg(F.max("__n")).first()[0] or 0
    width = -(-most // DOCUMENTS_IN_BLOCK)
    schema = "__place long, __block long, __node long, size long, __p double, __open boolean"
    while True:
        nodes = open_rows.withColumn("__node", F.expr(f"__node div {RESIDUALS_IN_BLOCK}"))
        done = materialised(
            nodes.groupBy("__place", "__node").applyInPandas(_round_residuals(seed, level), schema), "mixing"
        )
        closed.append(done.where("not __open").selectExpr("__place", "__block", "cast(round(__p) as long) as __last"))
        open_rows = done.where("__open").select("__place", "__block", "__node", "size", "__p")
        width = -(-width // RESIDUALS_IN_BLOCK)
        level += 1
        if width <= 1:
            break
    last = F.xxhash64(F.col("__place"), F.lit(seed)) % 1_000_003
    chance = F.abs(last) / 1_000_003.0
    closed.append(open_rows.select("__place", "__block", (chance < F.col("__p")).cast("long").alias("__last")))
    residuals = closed[0]
    for more in closed[1:]:
        residuals = residuals.unionByName(more)
    rounded = (
        first.where("__residual is null")
        .select("doc_id", "size", "__place", "__whole", "__taken")
        .unionByName(
            first.where("__residual is not null")
            .join(residuals, ["__place", "__block"])
            .select("doc_id", "size", "__place", "__whole", F.col("__last").alias("__taken"))
        )
        .unionByName(
            planned.where("size = 0").select("doc_id", "size", "__place", F.lit(0).cast("long").alias("__whole"), F.lit(0).cast("long").alias("__taken"))
        )
    )
    copies = F.col("__whole") + F.col("__taken")
    return rounded.join(broadcast_if_small(plan), "__place").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, seed: int = 7) -> DataFrame:
    """``documents`` with every row as many times as the mix takes it; documents without words are not taken.

    Rows of equal doc_id, source and size are interchangeable in the mix.
    """
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__id")
    turn = F.row_number().over(Window.partitionBy("__id").orderBy("__size", "__source")).alias("__turn")
    taken = mix(documents, weights, limit, seed).select(
        ids, F.col("size").alias("__size"), F.col("source").alias("__source"), F.col("copies").alias("__copies")
    )
    copies = taken.select("__id", turn, "__copies").where("__copies > 0")
    rows = documents.select(F.struct("*").alias("row"), ids, word_count(F.col("text")).alias("__size"), F.col("source").alias("__source"))
    numbered = rows.select("row", "__id", turn)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return numbered.join(copies, ["__id", "__turn"]).select("row", copy.alias("__copy")).select("row.*")
