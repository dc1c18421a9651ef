"""Sharding by a k-d tree over document metadata.

A point of the tree is a group of equal texts and weighs its bytes. Each node is cut at the weighted median of its widest
dimension, found by histograms that are refined around the median, until every leaf holds its share. Only histograms (nodes x bins)
reach the driver; the tree becomes one CASE expression. Groups that are heavy beside a leaf would make cuts uneven: they are put into
leaves first, the heaviest first and each into the lightest leaf, and the tree fills up what is left of every leaf. Only DataFrame and SQL
functions are used.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.numbering import number_rows
from tallymark.session import materialised
from tallymark.sources.literal import literal_rows

from .common import broadcast_if_light

DIMENSIONS = ("source", "lang", "length", "doc_id")
_BINS = 4096
_COORDINATE_BITS, _TIE_BITS = 20, 31
_PIECES = 32  # a group above 1/32 of a leaf is heavy
_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


@dataclass(frozen=True)
class Cut:
    dimension: str
    key: int  # points up to this key go to the left


def _placed(rows: DataFrame, column: str) -> DataFrame:
    """Replace a text by its place among all values it has, in the order of their bytes; null counts as empty."""
    value = F.coalesce(F.col(column), F.lit(""))
    places = number_rows(rows.select(value.alias(column)).distinct(), [column], "place")
    return rows.withColumn(column, value).join(broadcast_if_light(places), column).drop(column).withColumnRenamed("place", column)


def _points(sized: DataFrame) -> DataFrame:
    """One row for each group: its bytes and one coordinate for each dimension."""
    first = F.min(F.struct("doc_id", "source", "lang")).alias("first")
    grouped = sized.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.min("size").alias("length"), first)
    raw = grouped.selectExpr(
        "text_hash", "bytes", "ln(cast(length as double)) as length", "cast(first.doc_id as double) as doc_id",
        "first.source as source", "first.lang as lang", f"pmod(xxhash64(text_hash), {1 << _TIE_BITS}L) as tie",
    )
    whole = materialised(raw, "points")
    return materialised(_placed(_placed(whole, "source"), "lang"), "points")


def _keys(points: DataFrame) -> DataFrame:
    """Replace each coordinate by an integer key: its place in the range of the dimension, ties told apart by a hash."""
    limits = points.agg(
        *[F.min(d).alias(f"low_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"high_{d}") for d in DIMENSIONS]
    ).first()
    steps = (1 << _COORDINATE_BITS) - 1

    def key(d: str) -> Column:
        low, high = limits[f"low_{d}"], limits[f"high_{d}"]
        if low is None or high == low:
            return F.col("tie").alias(d)
        place = F.floor((F.coalesce(F.col(d), F.lit(low)) - F.lit(low)) / F.lit(high - low) * steps)
        return (place * (1 << _TIE_BITS) + F.col("tie")).alias(d)

    return points.select("text_hash", "bytes", *[key(d) for d in DIMENSIONS])


def _leaf(tree: dict[tuple[int, int], Cut], node: tuple[int, int]) -> str:
    """SQL: first shard of the node that a point lies in."""
    if node not in tree:
        return str(node[0])
    middle = (node[0] + node[1]) // 2
    cut = tree[node]
    below, above = _leaf(tree, (node[0], middle)), _leaf(tree, (middle, node[1]))
    return f"case when {cut.dimension} <= {cut.key} then {below} else {above} end"


def _fill(pieces: list[tuple[int, int, int]], shards: int, total: int) -> tuple[list[tuple[int, int, int]], list[float]]:
    """Shards for heavy pieces (text_hash, piece, bytes): the heaviest first, each into the lightest. Also what is left of every shard."""
    held = [(0, shard) for shard in range(shards)]
    homes = []
    for text_hash, piece, weight in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        load, shard = heapq.heappop(held)
        homes.append((text_hash, piece, shard))
        heapq.heappush(held, (load + weight, shard))
    loads = {shard: load for load, shard in held}
    return homes, [max(0.0, total / shards - loads[shard]) for shard in range(shards)]


def _split(points: DataFrame, room: list[float]) -> dict[tuple[int, int], Cut]:
    """The cuts of a tree whose leaves hold bytes in proportion to ``room``; node (a, b) holds the shards a to b - 1."""
    shards = len(room)
    tree: dict[tuple[int, int], Cut] = {}
    level = [(0, shards)]
    while level := [node for node in level if node[1] - node[0] > 1]:
        placed = points.withColumn("node", F.expr(_leaf(tree, (0, shards))))
        spread = placed.groupBy("node").agg(
            F.sum("bytes").alias("bytes"),
            *[F.min(d).alias(f"low_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"high_{d}") for d in DIMENSIONS],
        )
        found = {row["node"]: row for row in spread.collect()}
        search = {}
        for a, b in level:
            row = found.get(a)
            if row is None:
                tree[a, b] = Cut(DIMENSIONS[0], 0)
                continue
            widest = max(DIMENSIONS, key=lambda d: (row[f"high_{d}"] - row[f"low_{d}"]) >> _TIE_BITS)
            own, both = sum(room[a : (a + b) // 2]), sum(room[a:b])
            share = row["bytes"] * (own / both if both else 0.5)
            search[a, b] = [widest, row[f"low_{widest}"], row[f"high_{widest}"] + 1, share, row["bytes"]]
        while search:
            chosen = "case node " + " ".join(
                f"when {a} then ({d} - {low}L) div {max(1, -(-(high - low) // _BINS))}L" for (a, _), (d, low, high, *_) in search.items()
            ) + " end"
            inside = " or ".join(f"(node = {a} and {d} >= {low}L and {d} < {high}L)" for (a, _), (d, low, high, *_) in search.items())
            counted = placed.where(inside).groupBy("node", F.expr(chosen).alias("bin")).agg(F.sum("bytes").alias("bytes"))
            histogram = defaultdict(list)
            for row in counted.collect():
                histogram[row["node"]].append((row["bin"], row["bytes"]))
            for (a, b), (d, low, high, share, whole) in list(search.items()):
                width = max(1, -(-(high - low) // _BINS))
                for at, weight in sorted(histogram[a]):
                    start, end = low + at * width, min(high, low + (at + 1) * width)
                    if share <= weight:
                        break
                    share -= weight
                if width == 1 or weight * 100_000 <= whole:
                    tree[a, b] = Cut(d, end - 1 if 2 * share >= weight else start - 1)
                    del search[a, b]
                else:
                    search[a, b] = [d, start, end, share, whole]
        level = [child for a, b in level for child in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return tree


def kd_shards(documents: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards of nearly equal bytes (or into enough of ``target_bytes`` each).

    Returns doc_id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, shard and slot (gapless from 0 in each
    shard). Equal texts go to the same shard; only those that together are above a whole shard are split, by doc_id.
    Null ids, sources and languages count as the smallest. Repeated rows each get a slot; an empty table gives no
    rows; shards stay empty where there are fewer documents than shards. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialised(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", "lang",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sharding",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    count = shards or max(1, -(-total // (target_bytes or 1 << 30)))
    most = max(1, total // (count * _PIECES))
    pieces = F.when(F.col("group_bytes") * count > total, F.ceil(F.col("group_bytes") / most)).otherwise(1).alias("pieces")
    heavy = materialised(  # at most shards x 32 groups
        rows.groupBy("text_hash").agg(F.sum("size").alias("group_bytes")).where(F.col("group_bytes") > most).select("text_hash", pieces),
        "heavy",
    )
    of_heavy = rows.join(F.broadcast(heavy), "text_hash").withColumn(
        "piece", F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.col("pieces"))
    )
    weights = of_heavy.groupBy("text_hash", "piece").agg(F.sum("size").alias("bytes")).collect()  # at most shards x 64
    homes, room = _fill([(r["text_hash"], r["piece"], r["bytes"]) for r in weights], count, total)
    at = literal_rows(documents.sparkSession, {"text_hash": "bigint", "piece": "bigint", "shard": "int"}, homes)
    light = rows.join(F.broadcast(heavy), "text_hash", "left_anti")
    points = _keys(_points(light))
    shard = F.expr(_leaf(_split(points, room), (0, count))).cast("int").alias("shard")
    columns = ["doc_id", "size", "text_crc32", "shard", "row", F.shiftright("row", _PARTITION_BITS).alias("part")]
    placed = materialised(
        light.join(points.select("text_hash", shard), "text_hash").select(*columns)
        .unionByName(of_heavy.join(F.broadcast(at), ["text_hash", "piece"]).select(*columns)),
        "sharding",
    )
    return placed.sparkSession.sql(
        """
        with counted as (select shard, part, count(*) as n from {placed} group by shard, part),
        offsets as (
          select shard, part,
            coalesce(sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding), 0) as before
          from counted),
        numbered as (
          select *, row_number() over (partition by shard, part order by row) - 1 as place from {placed})
        select doc_id, size, text_crc32, shard, before + place as slot
        from numbered join offsets using (shard, part)
        """,
        placed=placed,
    )
