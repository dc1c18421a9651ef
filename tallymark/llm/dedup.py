"""Near-duplicate detection: circulant MinHash, banding, and exact Jaccard similarity on whole shingle sets.

Signature coordinate k of a set is the minimum of ``pi((sigma(x) - k) mod 2**32)`` over its shingles x: two fixed permutations, the
second one circularly shifted. Of each coordinate one byte is kept; five make a band. Steps:

1. sketch every document (one Python pass); documents with equal sets become one class at once, so copies cost nothing more;
2. classes that share a band form buckets; inside a bucket pairs are compared by size and signature, each pair in the first band it shares;
3. only classes with such a partner are fetched again with their whole sets, and compared exactly inside their buckets, each
   of which returns a spanning forest, never all pairs;
4. connected components.

Buckets above a size are dealt into chunks, and each pair of chunks is a group of its own: bounded memory, and no pair is left out.
There are as many bands as it takes to miss a pair at the threshold with a chance of 3e-7 only (26 at 0.85, 38 at 0.8).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import materialised

from .common import batches_of, broadcast_if_small, map_groups
from .components import stars

WORDS_IN_SHINGLE = 5
ROWS = 5
MISSED = 3e-7
CHUNK_MEMBERS = 4_096
CHUNK_SHINGLES = 2_000_000
_DEVIATIONS = 5.5
_TEXT_BYTES = 1 << 20
_SHINGLES_AT_ONCE = 1 << 16

_random = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _upper in range(65, 91):  # A-Z are read as a-z
    _BYTE[_upper] = _BYTE[_upper + 32]
_PLACE = _random.integers(0, 1 << 63, WORDS_IN_SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; empty for a text without words."""
    if not texts:
        return []
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    inside = _IN_WORD[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = change[::2], change[1::2]
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in texts]
    length = end - begin
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    position = np.arange(length.sum(), dtype=np.uint64) - np.repeat(first, length).astype(np.uint64)
    factor = _mix64((np.arange(int(length.max()), dtype=np.uint64) + np.uint64(1)) * _STEP) | np.uint64(1)
    words = _mix64(np.add.reduceat(_BYTE[data[inside]] * factor[position], first) + length.astype(np.uint64) * _STEP)
    text_ends = np.cumsum([len(t) + 1 for t in texts])  # in ``data``, which starts with one separator
    limits = np.concatenate(([0], np.searchsorted(begin, text_ends + 1)))
    n = len(words) - WORDS_IN_SHINGLE + 1
    shingles = np.zeros(max(n, 0), np.uint64)
    for j in range(WORDS_IN_SHINGLE if n > 0 else 0):
        shingles += words[j : j + n] * _PLACE[j]
    shingles = _mix64(shingles)
    sets = []
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        if b - a >= WORDS_IN_SHINGLE:
            sets.append(np.unique(shingles[a : b - WORDS_IN_SHINGLE + 1]))
        elif b > a:
            own = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            sets.append(_mix64(own + np.array([b - a], np.uint64) * _STEP))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - min(0.999, percent / 100) ** ROWS))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One byte for each coordinate of each (non-empty) set."""
    out = np.zeros((len(sets), coordinates), np.uint8)
    start = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    sigma = (_mix64(np.concatenate(sets) + _STEP) >> np.uint64(32)).astype(np.uint32)
    x, shifted = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(coordinates):
        np.subtract(sigma, np.uint32(k), out=x)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(x, np.uint32(shift), out=shifted)
            np.bitwise_xor(x, shifted, out=x)
            if factor:
                np.multiply(x, np.uint32(factor), out=x)
        least = np.minimum.reduceat(x, start)
        out[:, k] = (least ^ (least >> np.uint32(8)) ^ (least >> np.uint32(16))) & np.uint32(255)
    return out


def _text_bytes(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _sketch(coordinates: int):
    def work(batches):
        for frame in batches:
            texts = [_text_bytes(t) for t in frame["text"]]
            rows = list(zip(frame["doc_id"], frame["text_hash"], texts, strict=True))
            for part in batches_of(rows, [len(t) for t in texts], _TEXT_BYTES):
                sets = shingle_sets([t for *_, t in part])
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                full = [s for s in sets if len(s)]
                parts = batches_of(full, list(map(len, full)), _SHINGLES_AT_ONCE)
                found = iter([m for some in parts for m in signatures(some, coordinates)])
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(d) else int(d) for d, *_ in part], dtype="Int64"),
                        "text_hash": [h for _, h, _ in part],
                        "n_shingles": np.array([len(s) for s in sets], dtype=np.int64),
                        "key": keys,
                        "mark": [next(found).tobytes() if len(s) else None for s in sets],
                    }
                )

    return work


def _sets_of(batches):
    for frame in batches:
        texts = [_text_bytes(t) for t in frame["text"]]
        for part in batches_of(texts, list(map(len, texts)), _TEXT_BYTES):
            sets = [s for s in shingle_sets(part) if len(s)]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pd.DataFrame({"key": keys, "shingles": [s.tobytes() for s in sets]})


def _least_agreement(coordinates: int, similarity: float) -> int:
    """Coordinates on which a pair of this similarity agrees, less 5.5 standard deviations."""
    return int(coordinates * similarity - _DEVIATIONS * (coordinates * similarity * (1 - similarity)) ** 0.5)


def close_pairs(marks: np.ndarray, sizes: np.ndarray, chunk: np.ndarray, band: int, percent: int):
    """Pairs (i, more) of a bucket worth an exact comparison, each only in the first band it shares.

    ``chunk`` tells the two sides of a pair of chunks apart; with one chunk all pairs are looked at.
    """
    least, cross = _least_agreement(marks.shape[1], percent / 100), chunk.min() != chunk.max()
    for i in range(len(sizes)):
        others = np.flatnonzero(chunk > chunk[i]) if cross else np.arange(i + 1, len(sizes))
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        if len(others):
            same = marks[others] == marks[i]
            keep = same.sum(axis=1) >= least
            others, same = others[keep], same[keep]
        if len(others):
            shared = same.reshape(len(others), -1, ROWS).all(axis=2)
            others = others[shared.argmax(axis=1) == band]
        if len(others):
            yield i, others


def _screen(percent: int):
    def work(key, columns):
        own, sizes, chunk, marks = columns
        marks = np.frombuffer(b"".join(marks), np.uint8).reshape(len(own), -1)
        active = np.zeros(len(own), bool)
        for i, others in close_pairs(marks, np.array(sizes, np.int64), np.array(chunk), key[0], percent):
            active[i] = True
            active[others] = True
        for i in np.flatnonzero(active):
            yield (*key, own[i])

    return work


def forest(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set it is linked to, directly or through others, by ``100 * intersection >= percent * union``."""
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[shingle] > 1
    owner, shingle = owner[shared], shingle[shared]
    by_shingle = np.argsort(shingle, kind="stable")
    posting, holders = shingle[by_shingle], owner[by_shingle]
    start = np.searchsorted(posting, np.arange(len(count) + 1))
    own = np.searchsorted(owner, np.arange(len(sets) + 1))
    for i in range(1, len(sets)):
        mine = shingle[own[i] : own[i + 1]]
        if not len(mine):
            continue
        a, lengths = start[mine], start[mine + 1] - start[mine]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(holders[at], minlength=len(sets))[:i]
        for j in np.flatnonzero(100 * common >= percent * (sizes[:i] + sizes[i] - common)):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(sets))])


def _verify(percent: int):
    def work(_, columns):
        own, sets = columns
        found = forest([np.frombuffer(s, np.uint64) for s in sets], percent)
        for i in np.flatnonzero(found != np.arange(len(own))):
            yield own[i], own[found[i]]

    return work


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each row of ``documents`` (doc_id, text).

    Words are runs of characters other than ASCII white space, A-Z lowered; a document's set holds its 5-word shingles, or its
    whole word sequence if it is shorter. Documents are linked if ``100 * intersection >= percent * union``; ``component_id`` is
    the smallest doc_id of the connected component, ``kept`` marks the document that has it. A text without words (or null)
    is linked with nothing. A row without doc_id has the component of its text, and is kept only where that has no id at all.
    Repeated rows are all returned. An empty table gives no rows. Other columns are ignored.
    """
    return _with_roots(documents, percent).drop("root")


def _with_roots(documents: DataFrame, percent: int) -> DataFrame:
    """``near_duplicates`` with ``root``, which tells components apart even if they have the same smallest doc_id; null without words."""
    bands = bands_for(percent)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    schema = "doc_id long, text_hash long, n_shingles long, key binary, mark binary"
    sketch = materialised(hashed.mapInPandas(_sketch(bands * ROWS), schema), "sketch")
    ranked = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"), "doc_id", "n_shingles", "mark")
    classes = materialised(
        sketch.where("key is not null").groupBy("key").agg(F.min(ranked).alias("first"))
        .select("key", "first.doc_id", "first.n_shingles", "first.mark"),
        "classes",
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    part = F.substring("mark", F.col("band") * ROWS + 1, F.lit(ROWS)).alias("part")
    in_band = classes.select("key", "n_shingles", "mark", band.alias("band")).select("key", "n_shingles", "band", part)
    buckets = (
        in_band.groupBy("band", "part").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("total"))
        .where("members > 1")
        .select(
            "band", "part",
            F.ceil(F.greatest(F.col("members") / CHUNK_MEMBERS, F.col("total") / CHUNK_SHINGLES)).cast("int").alias("chunks"),
        )
    )
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk")
    members = in_band.join(buckets, ["band", "part"]).select("key", "band", "part", "chunks", chunk)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    grouped = members.select("*", other).select(
        "key", "band", "part", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj")
    )
    group = ["band", "part", "ci", "cj"]
    active = materialised(
        map_groups(
            grouped.join(classes, "key"), group, ["key", "n_shingles", "chunk", "mark"], _screen(percent),
            "band int, part binary, ci int, cj int, key binary",
        ),
        "close",
    )
    wanted = active.select("key").distinct().join(classes.select("key", "doc_id"), "key").select("doc_id")
    texts = rows.join(broadcast_if_small(wanted), rows["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    sets = materialised(texts.mapInPandas(_sets_of, "key binary, shingles binary").dropDuplicates(["key"]), "sets")
    edges = map_groups(
        active.join(sets, "key"), group, ["key", "shingles"], _verify(percent), "u binary, v binary"
    )
    roots = classes.select("key", "doc_id").join(stars(edges).toDF("key", "root"), "key", "left").select(
        "key", "doc_id", F.coalesce("root", "key").alias("root")
    )
    smallest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = materialised(roots.join(smallest, "root").select("key", "root", "component_id"), "components")
    own = sketch.select("doc_id", "text_hash", "n_shingles", "key").join(component, "key", "left").select(
        "doc_id", "text_hash", "n_shingles", "root",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return own.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(documents: DataFrame, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each component: the one that has its smallest doc_id (of repeated ids the smallest text hash).

    Documents without words all stay, one row for each doc_id and text; components without any doc_id keep one row.
    """
    found = _with_roots(documents, percent).where("kept")
    alone = [F.when(F.col("root").isNull(), F.col(c)).alias(f"__{c}") for c in ("doc_id", "text_hash")]
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    chosen = (
        found.groupBy("root", *alone).agg(F.min(F.struct(ids.alias("id"), "text_hash")).alias("one"))
        .select(F.col("one.id").alias("__id"), F.col("one.text_hash").alias("__hash"))
    )
    rows = documents.select(F.struct("*").alias("row"), ids.alias("__id"), F.xxhash64("text").alias("__hash"))
    first = Window.partitionBy("__id", "__hash").orderBy("__id")
    numbered = rows.withColumn("__turn", F.row_number().over(first)).where("__turn = 1")
    return numbered.join(chosen, ["__id", "__hash"], "left_semi").select("row.*")
