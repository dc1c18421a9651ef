"""Byte-level BPE by Spark higher-order functions.

A word is an array of token ids, at first one for each byte. A fold joins the neighbours of lowest rank (the rank of a pair is the id of
what it joins to) until no pair has a rank. The ranks are a constant of the plan: hash buckets of pairs, because a Spark map is searched from
its start. A word whose bytes are a token is that token at once.

Folding is dear and words repeat. The words of the corpus are counted; the most frequent, as many as a bound of bytes allows, are folded once and
reach all tasks. One pass over the texts looks them up, numbers the other words as it meets them, and the plan folds each of those once for the task,
between two Python steps of the same stage: no text and no rare word is shuffled. Where the words that are not known are a large share of the text
(``LATE_SHARE``), every distinct word is folded once instead: rows are dealt by number, and stay where they are dealt; the other words are read from
there, meet their ids in a join on the word, and come back to their row by its number, where their ids take the places left open.
Ranks and pieces are one-row tables, read as scalars: they get into tasks like literals, but not into the text of every plan, which the driver keeps.
Words of more than a kilobyte are merged by a heap in the tasks that count: an array that is copied for every merge would make them quadratic.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import materialised

KNOWN_BYTES = 32 << 20
"""Bound of the words (with their ids) that every task holds."""

LATE_SHARE = 1 / 8
"""Up to this share of all words, those that are not known are folded where they stand, once in each task; above, once for all, and joined."""

LONG_WORD_BYTES = 1_000
_WORD_BYTES = 64  # what a word costs beside its letters
_PAIR_BUCKETS = 1 << 15
_ID_BITS = 20
_NONE = 1 << 30
_WORDS_AT_ONCE = 1 << 18
_WORDS_COUNTED = 1 << 18
_COUNTS_IN_BATCH = 1 << 15
_IDS_IN_BATCH = 1 << 20
_ROWS_AT_ONCE = 1 << 10
_PARTS_KEPT = 1 << 18
_TEXT_IN_PARTS = 1 << 22
_PARTED_AT_BLANKS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}  # a blank begins a word after all but white space
_BLANK_BY_SPACE = re.compile(r"\s | \s")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_constant(rows: DataFrame, constant: DataFrame, name: str = "held") -> DataFrame:
    """``rows`` with the one value of a one-row table as a column.

    It is read once and held once by each task, if later expressions refer to it once: then Spark puts the scalar in its place, and
    never into rows.
    """
    value = constant.columns[0]
    return rows.sparkSession.sql(f"select *, (select first({value}) from {{constant}}) as {name} from {{rows}}", rows=rows, constant=constant)


class Ranks:
    """A rank file (base64 token and rank on each line) as constants; their size is bounded by that of the vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        if max(self.ranks.values(), default=0) >= 1 << _ID_BITS:
            raise ValueError("ranks of more than 20 bits are not supported")
        self.keys: list[list[int]] = [[] for _ in range(_PAIR_BUCKETS)]
        self.values: list[list[int]] = [[] for _ in range(_PAIR_BUCKETS)]
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    at = (a * 40_503 + b * 9_176_263) & (_PAIR_BUCKETS - 1)
                    self.keys[at].append((a << _ID_BITS) | b)
                    self.values[at].append(rank)

    def tables(self, spark: SparkSession) -> DataFrame:
        """One row: keys and values of the pair ranks, in buckets, and the ids of single bytes."""
        single = [self.ranks.get(bytes([b])) for b in range(256)]
        kind = "tables struct<keys: array<array<bigint>>, values: array<array<int>>, bytes: array<int>>"
        return materialised(spark.createDataFrame([((self.keys, self.values, single),)], kind), "ranks")

    @staticmethod
    def pair_ranks(tables: Column, lefts: Column, rights: Column) -> Column:
        """The ranks of the pairs (left, right) of two arrays of ids; ``_NONE`` for a pair without rank or with a null."""
        keys, values = tables["keys"], tables["values"]

        def rank(a: Column, b: Column) -> Column:
            at = (a.cast("bigint") * 40_503 + b * F.lit(9_176_263).cast("bigint")).bitwiseAND(F.lit(_PAIR_BUCKETS - 1)).cast("int")
            key = F.shiftleft(a.cast("bigint"), _ID_BITS).bitwiseOR(b.cast("bigint"))
            place = F.array_position(F.get(keys, at), key).cast("int") - 1
            return F.coalesce(F.get(F.get(values, at), place), F.lit(_NONE))

        return F.zip_with(lefts, rights, rank)

    def kind(self) -> str:
        """How ids are kept: in two bytes if the largest number of two bytes, which stands for a word whose ids are still to come, is no id."""
        return "<u2" if max(self.ranks.values(), default=0) < 0xFFFF else "<u4"

    def words(self) -> list[tuple[str, int]]:
        """The tokens that are whole texts: such a word is one token, whatever its merges would give."""
        found = ((token.decode("utf-8", "ignore"), token, rank) for token, rank in self.ranks.items())
        return [(text, rank) for text, token, rank in found if text.encode() == token]

    def pieces(self, spark: SparkSession) -> DataFrame:
        """One row: the bytes of each id, as ISO-8859-1 text; null for ids that are not used."""
        by_id = {rank: token.decode("latin-1") for token, rank in self.ranks.items()}
        rows = [([by_id.get(i) for i in range(max(by_id, default=-1) + 1)],)]
        return materialised(spark.createDataFrame(rows, "pieces array<string>"), "pieces")


def fold_merges(word: Column, held: Column) -> Column:
    """Ids of one word: of the pairs of lowest rank the first is joined, again and again, until no pair has a rank.

    ``held`` are the tables of ``Ranks``.
    """
    characters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")

    def joined(tables: Column, state: Column, least: Column) -> Column:
        parts, of_pairs = state["parts"], state["ranks"]

        def at(p: Column) -> Column:  # the pair is (p, p + 1), counted from 1
            before, after = F.get(parts, p - 2), F.get(parts, p + 1)
            fresh = Ranks.pair_ranks(tables, F.array(before, least), F.array(least, after))
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), p - 1), F.array(least), F.slice(parts, p + 2, F.size(parts))).alias("parts"),
                F.concat(
                    F.slice(of_pairs, F.lit(1), F.greatest(F.lit(0), p - 2)),
                    F.slice(fresh, F.when(p == 1, 2).otherwise(1), F.lit(2)),  # the first part has no left neighbour
                    F.slice(of_pairs, p + 2, F.size(of_pairs)),
                ).alias("ranks"),
            )

        return _let(F.array_position(of_pairs, least).cast("int"), at)

    def fold(tables: Column, ids: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            least = F.array_min(state["ranks"])
            return _let(least, lambda r: F.when(r == _NONE, state).otherwise(joined(tables, state, r)))

        # the last id has no right neighbour: its pair holds a null and has no rank, so that there are as many ranks as parts
        start = F.struct(ids.alias("parts"), Ranks.pair_ranks(tables, ids, F.slice(ids, 2, F.size(ids))).alias("ranks"))
        return F.aggregate(F.slice(ids, 2, F.size(ids)), start, step, lambda s: s["parts"])

    def folded(tables: Column) -> Column:
        return _let(F.transform(characters, lambda c: F.get(tables["bytes"], F.ascii(c))), lambda ids: fold(tables, ids))

    return _let(held, folded)


def merge_long(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """The same merges for a long word: a heap finds the lowest rank, links skip what has been joined."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(i: int):
        if i >= 0 and after[i] < n and (rank := ranks.get(word[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[after[i]]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n):
        pair(i)
    alive = [True] * n
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
            continue
        gone = after[i]
        alive[gone], end[i], after[i] = False, stop, after[gone]
        if after[i] < n:
            before[after[i]] = i
        pair(before[i])
        pair(i)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def packed(ids: Column, kind: str) -> Column:
    """An array of ids as bytes, two or four for each (``Ranks.kind``), the highest first; null if it holds a null."""
    digits = 2 * np.dtype(kind).itemsize
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), digits, "0")), "", "?"))


def _highest_first(kind: str) -> np.dtype:
    return np.dtype(kind).newbyteorder(">")


def _words_of(pattern: regex.Pattern, text: str | None) -> Iterator[list[str]]:
    """The words of a text, in lists of bounded length."""
    if not text:
        return
    if len(text) <= _WORDS_AT_ONCE:
        yield pattern.findall(text)
        return
    matches = pattern.finditer(text)
    while words := [m[0] for m in islice(matches, _WORDS_AT_ONCE)]:
        yield words


def _parts_of(text: str) -> list[str] | None:
    """What blanks part a text into, if each stands alone between other characters than white space; else nothing.

    By a pattern of ``_PARTED_AT_BLANKS`` the words of such a text are those of the first part, and of each other part behind a blank.
    """
    if not text or len(text) > _TEXT_IN_PARTS or text[0] == " " or text[-1] == " " or _BLANK_BY_SPACE.search(text):
        return None
    return text.split(" ")


def _counted(ranks, pattern: str, kind: str):
    """Each task's words with their counts, and the ids of long ones."""

    def work(batches):
        compiled, held, parts = regex.compile(pattern), Counter(), Counter()
        in_parts = pattern in _PARTED_AT_BLANKS

        def of_parts():
            """Count the words of the parts, which repeat as words do, so that the pattern reads each of them once."""
            once = []
            while parts:
                part, n = parts.popitem()
                if n == 1 and not part[-1].isspace():  # white space at the end of a text does not stand before a blank
                    once.append(part)
                else:
                    for word in compiled.findall(" " + part):
                        held[word] += n
            for at in range(0, len(once), _COUNTS_IN_BATCH):
                held.update(compiled.findall(" " + " ".join(once[at : at + _COUNTS_IN_BATCH])))

        def long_ids(word: str) -> bytes | None:
            if len(word) <= LONG_WORD_BYTES // 4 or len(raw := word.encode("utf-8", "surrogatepass")) <= LONG_WORD_BYTES:
                return None
            return np.array(merge_long(raw, ranks.value), _highest_first(kind)).tobytes()

        def counts():
            while held:
                some = [held.popitem() for _ in range(min(len(held), _COUNTS_IN_BATCH))]
                words, n = zip(*some, strict=True)
                columns = [pa.array(words, "string"), pa.array(n, "int64"), pa.array(map(long_ids, words), "binary")]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "long_ids"])

        for batch in batches:
            for text in (value.as_py() for value in batch.column("text")):
                if in_parts and (split := _parts_of(text)):
                    held.update(compiled.findall(split[0]))
                    parts.update(islice(split, 1, None))
                    if len(parts) > _WORDS_COUNTED:
                        of_parts()
                else:
                    for words in _words_of(compiled, text):
                        held.update(words)
                        if len(held) > _WORDS_COUNTED:
                            yield from counts()
                if len(held) > _WORDS_COUNTED:
                    yield from counts()
        of_parts()
        yield from counts()

    return work


def counted_words(texts: DataFrame, ranks: Ranks, pattern: str) -> DataFrame:
    """word, long_ids, n, rank: every distinct word of the texts, the ids (``packed``) of long ones, the rank of those that are tokens."""
    spark = texts.sparkSession
    work = _counted(spark.sparkContext.broadcast(ranks.ranks), pattern, ranks.kind())
    of_tasks = texts.select("text").mapInArrow(work, "word string, n long, long_ids binary")
    counted = of_tasks.groupBy("word", "long_ids").agg(F.sum("n").alias("n"))
    whole = spark.createDataFrame(pd.DataFrame(ranks.words(), columns=["word", "rank"]), "word string, rank int")
    return counted.join(whole.hint("broadcast"), "word", "left")


def _folded(counted: DataFrame, tables: DataFrame, kind: str) -> DataFrame:
    """word, n, ids (``packed``) of counted words."""
    ids = F.when(F.col("rank").isNotNull(), F.array("rank")).otherwise(fold_merges(F.col("word"), F.col("held")))
    either = F.when(F.col("long_ids").isNotNull(), F.col("long_ids")).otherwise(packed(ids, kind))
    return with_constant(counted, tables).select("word", "n", either.alias("ids"))


def folded_words(texts: DataFrame, ranks: Ranks, pattern: str) -> DataFrame:
    """word, n, ids (``packed``): every distinct word of the texts, folded once.

    It is counted and folded in one plan, without a table or an exchange between. Long words have got their ids in the tasks that count.
    """
    tables = ranks.tables(texts.sparkSession)
    return materialised(_folded(counted_words(texts, ranks, pattern), tables, ranks.kind()), "folded")


def known_words(folded: DataFrame, kind: str) -> dict[str, bytes]:
    """Ids (of ``Ranks.kind``) of the most frequent words, within ``KNOWN_BYTES``; counts are cut at powers of two."""
    cost = F.octet_length("word") + F.octet_length("ids") + _WORD_BYTES
    sizes = folded.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.sum(cost).alias("bytes")).orderBy(F.desc("level"))
    least, total = 1 << 62, 0
    for row in sizes.collect():  # at most 64 rows
        total += row["bytes"]
        if total > KNOWN_BYTES:
            break
        least = 1 << row["level"]
    return _as_bytes(folded.where(F.col("n") >= least), kind)


def _as_bytes(folded: DataFrame, kind: str) -> dict[str, bytes]:
    """Ids (of ``Ranks.kind``) of folded words."""
    frequent = folded.select("word", "ids").toPandas()
    return {word: np.frombuffer(ids, _highest_first(kind)).astype(kind).tobytes() for word, ids in zip(frequent["word"], frequent["ids"], strict=True)}


def frequent_words(counted: DataFrame, kind: str) -> tuple[DataFrame, float]:
    """The most frequent words that are no tokens, within ``KNOWN_BYTES``, and the share of all occurrences that are of no such word and no token."""
    width = np.dtype(kind).itemsize
    cost = F.octet_length("word") + F.coalesce(F.octet_length("long_ids"), width * F.octet_length("word")) + _WORD_BYTES
    level = F.floor(4 * F.log2("n")).cast("int")
    of_level = counted.groupBy(level.alias("level"), F.col("rank").isNotNull().alias("token")).agg(F.sum(cost).alias("bytes"), F.sum("n").alias("n"))
    least, total, late, occurrences = 1 << 30, 0, 0, 0
    for row in of_level.orderBy(F.desc("level")).collect():  # at most 512 rows
        occurrences += row["n"]
        if not row["token"]:
            total += row["bytes"]
            if total <= KNOWN_BYTES:
                least = row["level"]
            else:
                late += row["n"]
    some = counted.where(F.col("rank").isNull() & (level >= least))
    return some.repartition(max(16, counted.sparkSession.sparkContext.defaultParallelism), "word"), late / max(1, occurrences)


def squeezed(raw: bytes, kind: str) -> bytes:
    """Ids as zlib packs them: all their lowest bytes, then the next, because high bytes repeat and low ones do not."""
    return zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), 1)


def unsqueezed(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.frombuffer(planes.T.tobytes(), kind)


_LOOKED_UP = "doc_id long, text_md5 binary, ids binary, open_words array<string>"


def _looked_up(known, pattern: str, kind: str):
    """The ids of the known words of each text in their places, and the other words in order."""

    def work(batches):
        compiled, get, absent = regex.compile(pattern), known.value.get, _open(kind).tobytes()
        kinds = {"doc_id": pa.int64(), "text_md5": pa.binary(), "ids": pa.binary(), "open_words": pa.list_(pa.string())}
        done: dict[str, list] = {name: [] for name in kinds}
        held = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(done[name], of) for name, of in kinds.items()], names=list(kinds))

        for batch in batches:
            for doc_id, digest, text in zip(*(batch.column(name) for name in ("doc_id", "text_md5", "text")), strict=True):
                ids, late = [], []
                for words in _words_of(compiled, text.as_py()):
                    found = [get(w, absent) for w in words]
                    late += [w for w, x in zip(words, found, strict=True) if x is absent]
                    ids.append(b"".join(found))
                done["doc_id"].append(doc_id.as_py())
                done["text_md5"].append(digest.as_py())
                done["ids"].append(squeezed(raw := b"".join(ids), kind))
                done["open_words"].append(late)
                held += len(raw) // len(absent)
                if held > _IDS_IN_BATCH:
                    yield rows()
                    done, held = {name: [] for name in done}, 0
        yield rows()

    return work


_READ = "doc_id long, text_md5 binary, ids binary, late array<int>, word string, forget boolean"


def _read(known, ranks, pattern: str, kind: str):
    """The ids of the known words of each text in their places, and the numbers of the other words in order.

    Words get numbers from 0 as the task meets them, and each has a row of its own before the text; where ``forget`` is true the numbers begin anew.
    """

    def work(batches):
        compiled, get, absent = regex.compile(pattern), known.value.get, _open(kind).tobytes()
        in_parts, numbers = pattern in _PARTED_AT_BLANKS, {}
        of_parts: dict[str, bytes] = {}
        late_of_parts: dict[str, list[int]] = {}
        kinds = {"doc_id": pa.int64(), "text_md5": pa.binary(), "ids": pa.binary(), "late": pa.list_(pa.int32()), "word": pa.string(), "forget": pa.bool_()}
        done: dict[str, list] = {name: [] for name in kinds}
        held = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(done[name], of) for name, of in kinds.items()], names=list(kinds))

        def one(word: str, late: list[int], new: list[str]) -> bytes:
            if (found := get(word)) is not None:
                return found
            if len(word) > LONG_WORD_BYTES // 4 and len(raw := word.encode("utf-8", "surrogatepass")) > LONG_WORD_BYTES:
                return np.array(merge_long(raw, ranks.value), kind).tobytes()
            if (number := numbers.get(word)) is None:
                number = numbers[word] = len(numbers)
                new.append(word)
            late.append(number)
            return absent

        def coded(text: str | None, new: list[str]) -> tuple[bytes, list[int]]:
            late: list[int] = []
            if not in_parts or (parts := _parts_of(text)) is None:
                return b"".join([one(w, late, new) for words in _words_of(compiled, text) for w in words]), late
            first = b"".join([one(w, late, new) for w in compiled.findall(parts[0])])
            del parts[0]
            for part in set(parts).difference(of_parts):
                own: list[int] = []
                of_parts[part] = b"".join([one(w, own, new) for w in compiled.findall(" " + part)])
                if own:
                    late_of_parts[part] = own
            for part in filter(late_of_parts.__contains__, parts):
                late += late_of_parts[part]
            return first + b"".join(map(of_parts.__getitem__, parts)), late

        for batch in batches:
            for doc_id, digest, text in zip(*(batch.column(name) for name in ("doc_id", "text_md5", "text")), strict=True):
                forget = len(numbers) > _WORDS_COUNTED
                if forget:
                    numbers.clear()
                if forget or len(of_parts) > _PARTS_KEPT:
                    of_parts.clear()
                    late_of_parts.clear()
                raw, late = coded(text.as_py(), new := [])
                of_words = [None] * len(new)
                for name, value in zip(("doc_id", "text_md5", "ids", "late"), (doc_id.as_py(), digest.as_py(), raw, late), strict=True):
                    done[name] += [*of_words, value]
                done["word"] += [*new, None]
                done["forget"] += [forget, *[False] * len(new)]
                held += len(new) + len(raw) // len(absent)
                if held > _IDS_IN_BATCH:
                    yield rows()
                    done, held = {name: [] for name in done}, 0
        yield rows()

    return work


def _filled(kind: str):
    """Put the ids of the words that a task has numbered into their places."""

    def work(batches):
        own: list[bytes] = []
        for batch in (some.slice(at, _ROWS_AT_ONCE) for some in batches for at in range(0, len(some), _ROWS_AT_ONCE)):
            lists = batch.column("new_ids")
            values = lists.flatten()
            if values.null_count:
                raise ValueError("a word holds a byte that has no id")
            raw = values.to_numpy(zero_copy_only=False).astype(kind).tobytes()
            stops = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) * np.dtype(kind).itemsize
            doc_ids, digests, done = [], [], []
            columns = (batch.column(name).to_pylist() for name in ("doc_id", "text_md5", "ids", "late", "forget"))
            for doc_id, digest, ids, late, forget, start, stop in zip(*columns, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                if forget:
                    own.clear()
                if ids is None:
                    own.append(raw[start:stop])
                    continue
                doc_ids.append(doc_id)
                digests.append(digest)
                done.append(_with_late(np.frombuffer(ids, kind), [own[i] for i in late], np.dtype(kind)))
            ends = np.cumsum([0, *map(len, done)])
            full = pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.array(np.concatenate([np.empty(0, np.int32), *done])))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, "int64"), pa.array(digests, "binary"), full], names=["doc_id", "text_md5", "ids"])

    return work


def _late_words(batches):
    """The open words of each row with their places.

    All columns come in, though two are used: with fewer, Spark would prune them before the rows are dealt, and deal (and look up) twice.
    """
    for batch in batches:
        lists = batch.column("open_words")
        of_row, words = lists.value_parent_indices(), lists.flatten()
        owner = of_row.to_numpy(zero_copy_only=False)
        first = np.searchsorted(owner, owner)
        place = np.arange(len(owner)) - first
        yield pa.RecordBatch.from_arrays([batch.column("row").take(of_row), pa.array(place, "int32"), words], names=["row", "place", "word"])


def _open(kind: str | np.dtype) -> np.generic:
    """Stands for a word whose ids are still to come."""
    return np.dtype(kind).type(np.iinfo(kind).max)


def _with_late(ids: np.ndarray, late: Sequence[bytes], of_late: np.dtype) -> np.ndarray:
    """The ids of a text with those of its open words, in the order of their places."""
    at = np.flatnonzero(ids == _open(ids.dtype))
    if len(at) != len(late):
        raise ValueError("a text has not got the ids of all its words")
    if not len(at):
        return ids.astype(np.int32)
    sizes = np.ones(len(ids), np.int64)
    sizes[at] = [len(own) // ids.itemsize for own in late]
    full = np.repeat(ids.astype(np.int32), sizes)
    full[np.repeat(ids == _open(ids.dtype), sizes)] = np.frombuffer(b"".join(late), of_late)
    return full


def _assembled(kind: str):
    """Put the ids of open words, in the order of their places, into the ids of a text."""

    def work(batches):
        for frame in (some.iloc[at : at + _ROWS_AT_ONCE].reset_index(drop=True) for some in batches for at in range(0, len(some), _ROWS_AT_ONCE)):
            done = []
            for packed_ids, late in zip(frame["ids"], frame["late"], strict=True):
                done.append(_with_late(unsqueezed(packed_ids, kind), [] if late is None else late, _highest_first(kind)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text_md5": frame["text_md5"], "ids": pd.Series(done, dtype=object)})

    return work


def encode(documents: DataFrame, ranks: Ranks, pattern: str) -> DataFrame:
    """doc_id, text_md5, ids: the token ids of each whole text (null or empty: none).

    The texts are looked up when the result is asked for, once each time.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.select("doc_id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("text_md5"), "text")
    if not KNOWN_BYTES:
        return _through_a_join(rows, folded_words(texts, ranks, pattern), ranks, pattern)
    kind = ranks.kind()
    counted = materialised(counted_words(texts, ranks, pattern), "counted", compression="zstd")
    frequent, late = frequent_words(counted, kind)
    tables = ranks.tables(spark)
    if late > LATE_SHARE:
        return _through_a_join(rows, materialised(_folded(counted, tables, kind), "folded"), ranks, pattern)
    known = {word: np.array([rank], kind).tobytes() for word, rank in ranks.words()} | _as_bytes(_folded(frequent, tables, kind), kind)
    constants = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(ranks.ranks)
    read = with_constant(rows.mapInArrow(_read(*constants, pattern, kind), _READ), tables)
    new_ids = F.when(F.col("word").isNotNull(), fold_merges(F.col("word"), F.col("held"))).alias("new_ids")
    filled = read.select("doc_id", "text_md5", "ids", "late", "forget", new_ids)
    return filled.mapInArrow(_filled(kind), "doc_id long, text_md5 binary, ids array<int>")


def _through_a_join(rows: DataFrame, folded: DataFrame, ranks: Ranks, pattern: str) -> DataFrame:
    """The same where many words are not known: their ids come by a join on the word and return to their row by its number."""
    known = rows.sparkSession.sparkContext.broadcast(known_words(folded, ranks.kind()))
    looked_up = rows.mapInArrow(_looked_up(known, pattern, ranks.kind()), _LOOKED_UP).withColumn("row", F.monotonically_increasing_id())
    dealt = looked_up.repartition("row")  # one exchange, read by the late words and again by the join of the rows
    late = dealt.mapInArrow(_late_words, "row long, place int, word string")
    joined = late.join(folded.select("word", F.col("ids").alias("own")), "word")
    gathered = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "own"))).alias("l")).selectExpr("row", "l.own as late")
    complete = dealt.join(gathered.hint("merge"), "row", "left")
    all_there = F.size("open_words") == F.coalesce(F.size("late"), F.lit(0))
    lost = F.raise_error(F.lit("a text has not got the ids of all its words"))
    complete = complete.select("doc_id", "text_md5", "ids", F.when(all_there, F.col("late")).otherwise(lost).alias("late"))
    return complete.mapInPandas(_assembled(ranks.kind()), "doc_id long, text_md5 binary, ids array<int>")


def decode(ids: Column, held: Column) -> Column:
    """The bytes that the ids stand for: their pieces (``held``) one after the other."""
    return F.encode(F.array_join(_let(held, lambda pieces: F.transform(ids, lambda i: F.get(pieces, i))), ""), "ISO-8859-1")


def encode_and_decode(documents: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, text_md5 (of the UTF-8 text, null counts as empty), ids, decoded (bytes) for every row; an empty table gives no rows.

    Repeated rows are all returned, other columns are ignored. Words and texts may be of any length.
    """
    ranks = Ranks(rank_path)
    coded = with_constant(encode(documents, ranks, pattern), ranks.pieces(documents.sparkSession))
    return coded.select("doc_id", "text_md5", "ids", decode(F.col("ids"), F.col("held")).alias("decoded"))
