"""Order MinHash fingerprints, by DataFrame and SQL functions only.

The k-mers of a text are runs of ``k`` words (a character of a script without word spaces is a word). Repeated k-mers are
told apart by their occurrence number. One hash deals all numbered k-mers into bins; in each bin the ``l`` smallest are
selected, put back into the order they have in the text, and hashed as a tuple. Moving a passage changes the tuples, so the
share of equal tuples follows the edit distance and not only the content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.numbering import number_rows

K, L = 2, 2
BIN_BITS = 6
ROWS_IN_BUCKET = 1_024
MOST_BUCKETS = 1 << 16
"""Bound of the list of range starts, which every task holds (2 MB); larger tables get larger ranges."""

_ALONE = r"\u0E00-\u0E7F\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF"
WORD = rf"[{_ALONE}]|[^\s{_ALONE}]+"
_TUPLE_BITS = 48


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin(g: Column) -> Column:
    return F.shiftright(g, 64 - BIN_BITS)


def fingerprint(text: Column, k: int = K, size: int = L) -> Column:
    """One 64-bit entry (bin number, hash of the bin's tuple) for each bin that has k-mers; empty for a text without words."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.xxhash64(w))

    def kmers(h: Column) -> Column:
        following = lambda i: [F.get(h, i + j) for j in range(1, k)]
        return F.transform(h, lambda x, i: F.struct(F.xxhash64(x, *following(i)).alias("g"), i.alias("p")))

    def is_first(s: Column) -> Callable[[Column, Column], Column]:
        return lambda x, i: (i == 0) | (F.get(s, i - 1)["g"] != x["g"])

    def numbered(r: Column) -> Column:
        """Of further occurrences in hash order: the n-th of each k-mer gets a hash of its own. The first keeps its hash."""
        places = F.sequence(F.lit(0), F.size(r) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(r, i)["g"] != F.get(r, i - 1)["g"]))

        def run(begin: Column, end: Column) -> Column:
            own = F.slice(r, begin + 1, end - begin)
            return F.transform(own, lambda x, n: F.struct(F.xxhash64(x["g"], n).alias("g"), x["p"].alias("p")))

        return F.when(F.size(r) == 0, r).otherwise(
            _let(starts, lambda b: F.flatten(F.transform(b, lambda at, j: run(at, F.coalesce(F.get(b, j + 1), F.size(r))))))
        )

    def smallest(t: Column) -> Column:
        return F.filter(t, lambda x, i: (i < size) | (_bin(F.get(t, i - size)["g"]) != _bin(x["g"])))

    def tuples(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        heads = F.filter(places, lambda i: (i == 0) | (_bin(F.get(t, i)["g"]) != _bin(F.get(t, i - 1)["g"])))

        def entry(i: Column) -> Column:
            number = _bin(F.get(t, i)["g"])
            own = F.filter(F.slice(t, i + 1, size), lambda x: _bin(x["g"]) == number)
            in_text_order = F.sort_array(F.transform(own, lambda x: F.struct(x["p"].alias("p"), x["g"].alias("g"))))
            value = F.xxhash64(F.transform(in_text_order, lambda x: x["g"]))
            return F.shiftleft(number, _TUPLE_BITS).bitwiseOR(value.bitwiseAND(F.lit((1 << _TUPLE_BITS) - 1)))

        return F.transform(heads, entry)

    def of_words(h: Column) -> Column:
        def selected(s: Column) -> Column:
            """The smallest of the first and of the further occurrences; only the latter have to be sorted again."""
            further = F.filter(s, lambda x, i: ~is_first(s)(x, i))
            both = F.concat(
                _let(F.filter(s, is_first(s)), smallest),
                _let(further, lambda r: _let(F.sort_array(numbered(r)), smallest)),
            )
            return _let(F.sort_array(both), smallest)

        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            _let(F.sort_array(kmers(h)), lambda s: _let(selected(s), tuples))
        )

    return _let(words, of_words)


def fingerprint_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column, size: int = L) -> Column:
    """Share of equal tuples among the bins used by either text, to the power 1 / l: about the share of common k-mers in common order.

    Two texts without words are alike (1).
    """
    bins = lambda x: F.transform(x, lambda e: F.shiftright(e, _TUPLE_BITS))
    used = F.size(F.array_union(bins(a), bins(b)))
    share = F.size(F.array_intersect(a, b)) / used
    return F.when(used == 0, 1.0).otherwise(F.pow(share, F.lit(1.0 / size)))


def _place(bounds: Column, key: Column, steps: int) -> Column:
    """Binary search: the number (from 0) of the last bound that is not above ``key``; 0 if all are."""
    widths = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])

    def step(at: Column, width: Column) -> Column:
        following = F.get(bounds, at + width)
        return F.when(following.isNotNull() & (following <= key), at + width).otherwise(at)

    return F.aggregate(widths, F.lit(0), step)


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__bucket``: in descending ``doc_id`` (null last), the rows are dealt into ranges of equal *number*, about a thousand
    each and at most ``MOST_BUCKETS`` in all, wherever their ids lie. Rows that repeat an id are ordered by a hash of their text, so that they
    are dealt as well; only rows that agree in both lie in one range. The first row of each range is handed to the range before it as well
    (``__tail`` 1), so that each range finds its neighbours alone.
    """
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("d"), F.xxhash64("text").alias("h"))
    keys = rows.select(key.alias("__key"))
    size = max(ROWS_IN_BUCKET, -(-keys.count() // MOST_BUCKETS))
    first = number_rows(keys, ["__key"], "place", start=-1).where(F.col("place") % size == 0).select("__key").distinct()
    bounds = first.agg(F.sort_array(F.collect_list("__key")).alias("bounds"))  # one row of at most MOST_BUCKETS keys
    n = first.count()
    held = rows.sparkSession.sql("select *, (select first(bounds) from {bounds}) as __held from {rows}", bounds=bounds, rows=rows.select("*", key.alias("__key")))

    def places(found: Column) -> Column:
        def own(at: Column) -> Column:
            here = F.struct(at.alias("__bucket"), F.lit(0).alias("__tail"))
            before = F.struct(F.pmod(at - 1, F.lit(max(1, n))).alias("__bucket"), F.lit(1).alias("__tail"))
            return F.when(F.get(found, at) == F.col("__key"), F.array(here, before)).otherwise(F.array(here))

        return _let(_place(found, F.col("__key"), max(1, n.bit_length())), own)

    return held.select(*rows.columns, "__key", F.inline(_let(F.col("__held"), places)))


def with_next(ranged: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row that follows in descending ``doc_id`` (null last); after the last comes the first.

    Rows that repeat an id follow in the order of a hash of their text.
    """
    window = Window.partitionBy("__bucket").orderBy("__tail", "__key", *columns)
    followed = ranged.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return followed.where("__tail = 0").drop("__bucket", "__tail", "__key")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of every text (null: empty) and of its edited text, and how alike they and the next document's are.

    The edited text has its last half (code points, rounded down) replaced by as many of the next document's first, in descending doc_id.
    A single document follows itself; an empty table gives no rows; repeated rows are kept. Other columns are ignored.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    ranged = in_ranges(rows).withColumn("entries", fingerprint(F.col("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    paired = with_next(ranged, ["text", "entries"]).select(
        "doc_id", n.cast("long").alias("n_chars"), "entries", "next_entries", edited.alias("edited")
    )
    both = paired.select(
        "doc_id", "n_chars", "entries", "next_entries",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("edited")).alias("edited_entries"),
    )
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("entries")).alias("fingerprint"),
        fingerprint_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
