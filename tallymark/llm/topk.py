"""Exact top-k search by inner product: columnar branch and bound.

Vectors lie in vertical layout (one contiguous array for each dimension). Partial scores are added up one block of dimensions
at a time; what the remaining dimensions can still add is bounded by the product of the remaining lengths of both vectors
(Cauchy-Schwarz), and candidates that cannot reach the k-th best any more are compacted away.

Queries and candidates are dealt into blocks of bounded size; each pair of a query block and a candidate block is a group of its own,
so that no task and no broadcast grows with the data. The best k of each group meet in one more top-k for each query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES_IN_BLOCK = 16_384
QUERIES_IN_BLOCK = 1_024
DIMENSIONS_IN_STEP = 16
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """``id``, ``v`` with ``floor(scale * x)`` for each component.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Of rows that repeat an id the smallest
    vector stands for all.
    """
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    usable = F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists(
        "x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return (
        vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), vector.alias("x"))
        .where(usable)
        .select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
    )


def vertical(vectors, dimensions: int) -> np.ndarray:
    """One row for each dimension; shorter vectors are filled up with zeros."""
    columns = np.zeros((dimensions, len(vectors)), dtype=np.int64)
    for i, v in enumerate(vectors):
        columns[: len(v), i] = v
    return columns


def best_of_block(query_ids, queries, ids, vectors, k: int) -> dict[str, np.ndarray]:
    """The k best candidates of this block for every query of this block, as (query, candidate, score) columns.

    Scores are exact integers; those beyond 64 bits stop at the largest or smallest long.
    """
    width = max([1, *map(len, queries), *map(len, vectors)])
    c, q = vertical(vectors, width), vertical(queries, width)
    largest = float(np.abs(c.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * width
    order = np.argsort(-(c.astype(float) ** 2).sum(axis=1), kind="stable")  # dimensions with most mass first
    c, q = c[order], q[order]
    kind = np.float64 if largest < _EXACT else np.int64 if largest < 2.0**62 else object
    c, q = c.astype(kind), q.astype(kind)
    steps = [slice(s, min(s + DIMENSIONS_IN_STEP, width)) for s in range(0, width, DIMENSIONS_IN_STEP)]

    def remaining(m: np.ndarray) -> np.ndarray:
        mass = np.array([(m[s].astype(float) ** 2).sum(axis=0) for s in steps] + [np.zeros(m.shape[1])])
        return np.sqrt(np.cumsum(mass[::-1], axis=0)[::-1])

    c_rest, q_rest = remaining(c), remaining(q)
    found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    for j, query_id in enumerate(query_ids):
        alive = np.flatnonzero(ids != query_id)
        score = np.zeros(len(alive), dtype=kind)
        for b, step in enumerate(steps):
            if not len(alive):
                break
            whole = len(alive) == c.shape[1] - (ids == query_id).sum()
            score = score + (q[step, j] @ c[step])[alive] if whole else score + q[step, j] @ c[step][:, alive]
            if b + 1 < len(steps) and len(alive) > k:
                bound = q_rest[b + 1, j] * c_rest[b + 1][alive] * (1 + 1e-9) + 1
                now = score.astype(float)
                lowest = np.partition(now - bound, len(now) - k)[len(now) - k]  # k candidates reach at least this
                keep = now + bound >= lowest
                if not keep.all():
                    alive, score = alive[keep], score[keep]
        top = np.lexsort((ids[alive], -score))[:k] if kind is not object else sorted(
            range(len(alive)), key=lambda i: (-score[i], ids[alive[i]])
        )[:k]
        found["query_id"].append(np.full(len(top), query_id, dtype=np.int64))
        found["vec_id"].append(ids[alive[top]])
        exact = score[top] if kind is not object else [max(-(2**63), min(2**63 - 1, int(score[i]))) for i in top]
        found["score"].append(np.asarray(exact).astype(np.int64))
    return {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in found.items()}


def exact_top_k(
    vectors: DataFrame, is_query: str, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 64.0
) -> DataFrame:
    """For every row that satisfies the SQL condition ``is_query`` on ``id``: its ``k`` largest inner products with other rows.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, and fewer rows are returned where fewer exist. An empty
    table gives no rows. Vectors of different lengths are compared as if filled up with zeros. See ``quantised`` for
    nulls and repeated rows. Other columns are ignored.
    """
    rows = quantised(vectors, id_column, vector_column, scale)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(is_query)).alias("q")).first()
    candidate_blocks = max(1, -(-counts["n"] // CANDIDATES_IN_BLOCK))
    query_blocks = max(1, -(-counts["q"] // QUERIES_IN_BLOCK))

    def block(blocks: int, seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    queries = rows.where(is_query).select(block(query_blocks, 1).alias("qb"), every(candidate_blocks).alias("cb"), "id", "v")
    candidates = rows.select(every(query_blocks).alias("qb"), block(candidate_blocks, 2).alias("cb"), "id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = right["id"].to_numpy(np.int64)
        return pd.DataFrame(best_of_block(left["id"].to_numpy(np.int64), list(left["v"]), ids, list(right["v"]), k))

    partial = (
        queries.groupBy("qb", "cb")
        .cogroup(candidates.groupBy("qb", "cb"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
