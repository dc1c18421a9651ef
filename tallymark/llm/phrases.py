"""Frequent phrases (collocations) of each language by Rabin-Karp fingerprints.

The words of a text stand, joined by single blanks, in one byte stream. Prefix sums of the polynomial of that stream modulo 2^64 give the
fingerprint of any n-gram as the difference of two of them, times an inverse power of the base. Level by level, n = 1, 2, ...:

1. words are counted by their text; the most frequent ones, as many as a bound of bytes allows, are numbered;
2. every task takes the n-grams whose two (n-1)-grams are frequent (no other can be), adds equal ones up, and shuffles only (numbers of
   their words, count); an n-gram that holds a frequent word without a number goes as text;
3. the fingerprints of the frequent n-grams become a bitmap of bounded size; a false positive only costs work.

Many n-grams of frequent parts are rare themselves, the more of them the more parts reach the fixed threshold. From n = 3 on, where that many
occurrences are to be expected, they are screened before they are counted: their fingerprints are dealt into buckets, two bytes an occurrence,
and only n-grams whose bucket has come to the threshold are counted. No frequent one can be in another bucket.

Numbers and texts tell n-grams apart exactly: counts do not depend on fingerprints, which can only let too much through. Each level is
its own result, so that no occurrence is looked up again, and texts of phrases are written once, behind the shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialised

from .common import broadcast_if_light, map_groups

LONGEST = 5
LEAST = 100
TOP = 2_000
CHUNK_BYTES = 1 << 20
KEPT_COUNTS = 2_000_000
KEPT_TEXTS = 300_000
KNOWN_BYTES = 16 << 20
"""Bound of the numbered words that every task holds."""

BITS_PER_KEY = 16
MOST_BITS = 1 << 29
SCREENED_FROM = 1_000_000
"""Occurrences of frequent (n-1)-grams from which n-grams are screened before they are counted."""

SCREEN_LOAD = 8
"""Occurrences for each bucket of a screen, as far as ``MOST_BITS`` allows."""

KEPT_PLACES = 2_000_000
_BLOCK_BITS = 16
_WORD_BYTES = 64  # what a word costs beside its letters

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDS = re.compile(rb"[^\x20\x09.,;:!?\n-\r]+")
_END_OF_WORD = re.compile(rb"[\x20\x09.,;:!?\n-\r]")
_MORE_WORDS = re.compile(rb"(?:[\x20\x09.,;:!?\n-\r]+[^\x20\x09.,;:!?\n-\r]+){0,4}")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                grown = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
                grown[0] = 1
                setattr(self, name, np.cumprod(grown, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def chunks(texts: Iterator[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes, int]]]:
    """Lists of (language, bytes, own bytes) of about ``CHUNK_BYTES``. A long text is cut behind words; each part but the last carries
    the next four words along, in which no n-gram of its own begins."""
    held, size = [], 0
    for lang, text in texts:
        at = 0
        while len(text) - at > CHUNK_BYTES and (cut := _END_OF_WORD.search(text, at + CHUNK_BYTES)):
            yield [(lang, text[at : _MORE_WORDS.match(text, cut.start()).end()], cut.start() - at)]
            at = cut.start()
        if size + len(text) - at > CHUNK_BYTES and held:
            yield held
            held, size = [], 0
        held.append((lang, text[at:], len(text) - at))
        size += len(text) - at
    if held:
        yield held


class Stream:
    """The words of a chunk in one byte stream, and the fingerprints of its n-grams."""

    def __init__(self, chunk: list[tuple[str, bytes, int]], powers: Powers):
        data = np.frombuffer(b"\n".join([b"", *(text for _, text, _ in chunk), b""]), np.uint8)
        kind = _KIND[data]
        inside = kind == _WORD
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, end = change[::2], change[1::2]
        length = end - begin
        self.words = len(begin)
        kept = inside.copy()
        kept[end] = True  # one separator behind every word
        stream = np.where(inside, _LOWER[data], np.uint8(32))[kept]
        self.bytes = stream
        self.start = np.cumsum(length + 1) - (length + 1)
        self.end = self.start + length
        breaks = np.cumsum(kind == _BREAK, dtype=np.int32)
        self.piece = breaks[begin]
        segment = np.cumsum([len(text) + 1 for _, text, _ in chunk])  # where the next one begins, after the leading separator
        owner = np.searchsorted(segment, begin - 1, side="right")
        self.own = begin - 1 - np.concatenate(([0], segment))[owner] < np.array([own for *_, own in chunk])[owner]
        self.names = sorted({lang for lang, *_ in chunk})
        code = {lang: i for i, lang in enumerate(self.names)}
        self.lang = np.array([code[lang] for lang, *_ in chunk], np.int32)[owner]
        up, down = powers.of(len(stream) + 1)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((stream.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        self.down = down
        self.salt = np.array([hash_of(lang) for lang in self.names], np.uint64)[self.lang]

    def inside_pieces(self, n: int) -> np.ndarray:
        """Which words begin an n-gram that ends in the same piece."""
        fits = np.zeros(self.words, bool)
        if self.words >= n:
            fits[: self.words - n + 1] = self.piece[: self.words - n + 1] == self.piece[n - 1 :]
        return fits

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams that begin at the words ``at``, told apart by language and n."""
        start = self.start[at]
        value = (self.prefix[self.end[at + n - 1]] - self.prefix[start]) * self.down[start]
        return _mix(value + self.salt[at] * np.uint64(2 * n + 1) + np.uint64(n))

    def numbers(self, known: dict[str, dict[bytes, int]], at: np.ndarray | None = None) -> np.ndarray:
        """The number of each word, or of those ``at`` some places; -1 for words without one."""
        raw = self.bytes.tobytes()
        gets = [known.get(name, {}).get for name in self.names]
        if at is None:
            return np.fromiter((gets[i](word, -1) for i, word in zip(self.lang.tolist(), raw.split(b" "))), np.int64, self.words)
        places = zip(self.lang[at].tolist(), self.start[at].tolist(), self.end[at].tolist(), strict=True)
        return np.fromiter((gets[i](raw[a:b], -1) for i, a, b in places), np.int64, len(at))

    def frequent(self, n: int, maps: list[np.ndarray | None], alive: np.ndarray) -> np.ndarray:
        """Words that begin an n-gram which all bitmaps up to length n (or as many as there are) let through; ``alive``: the words to look at."""
        for m in range(1, n + 1):
            alive = alive & self.inside_pieces(m)
            if m > 1:
                alive[:-1] &= before[1:]
                alive[-1:] = False
            if m <= len(maps) and maps[m - 1] is not None:
                at = np.flatnonzero(alive)
                alive[at] = in_bitmap(self.keys(at, m), maps[m - 1])
            before = alive.copy()
        return alive

    def text(self, word: int, n: int) -> bytes:
        return self.bytes[self.start[word] : self.end[word + n - 1]].tobytes()


def hash_of(lang: str) -> int:
    """A 62-bit hash of a language name that is the same in every process."""
    value = 0
    for b in lang.encode("utf-8", "surrogatepass"):
        value = (value * 1_000_003 + b + 1) & ((1 << 62) - 1)
    return value


def key_of(lang: str, text: bytes, n: int, powers: Powers) -> int:
    """The fingerprint of one phrase, as ``Stream.keys`` gives it, as a signed number."""
    up, _ = powers.of(len(text))
    value = (np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up
    salt = np.array([hash_of(lang)], np.uint64)
    return int(_mix(value.sum(keepdims=True) + salt * np.uint64(2 * n + 1) + np.uint64(n)).view(np.int64)[0])


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return keys & mask, (keys >> np.uint64(32)) & mask


def in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for place in _places(keys, 8 * len(bitmap)):
        found &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
    return found


def _passes(keys: np.ndarray, screen: np.ndarray) -> np.ndarray:
    """Which keys are in a bucket that has come to the threshold."""
    place = keys & np.uint64(8 * len(screen) - 1)
    return (screen[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _texts(batches) -> Iterator[tuple[str, bytes]]:
    for frame in batches:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            if text:
                yield lang, text.encode("utf-8", "surrogatepass")


def _word_counts(batches):
    """The words of each language with their counts, and without a word the number of all of them."""
    held: dict[str, Counter] = {}
    totals = Counter()

    def frame() -> pd.DataFrame:
        rows = [(lang, word.decode("utf-8", "surrogatepass"), n) for lang, counts in held.items() for word, n in counts.items()]
        rows += [(lang, None, n) for lang, n in totals.items()]
        held.clear()
        totals.clear()
        return pd.DataFrame(rows, columns=["lang", "phrase", "n"])

    for chunk in chunks(_texts(batches)):
        for lang, text, own in chunk:
            words = _WORDS.findall(text[:own].lower())
            held.setdefault(lang, Counter()).update(words)
            totals[lang] += len(words)
        if sum(map(len, held.values())) > KEPT_TEXTS:
            yield frame()
    yield frame()


def _packed(numbers: np.ndarray) -> np.ndarray:
    """Columns of two word numbers (below 2^31) each; the last one may hold a single number."""
    n = numbers.shape[1]
    pairs = [(numbers[:, k] << 32) | (numbers[:, k + 1] if k + 1 < n else 0) for k in range(0, n, 2)]
    return np.stack(pairs)


def _added_up(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows added up. Rows are brought together by a mix of their columns; where two mixes meet, a row may come twice, never wrongly."""
    mixed = columns[0].view(np.uint64)
    for column in columns[1:]:
        mixed = mixed * _BASE + column.view(np.uint64)
    order = np.argsort(mixed, kind="stable")
    columns, counts = columns[:, order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)))) if len(counts) else np.zeros(0, np.int64)
    return columns[:, first], np.add.reduceat(counts, first) if len(first) else counts


def _numbered(words: list[tuple[str, bytes]]) -> dict[str, dict[bytes, int]]:
    known: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(words):
        known.setdefault(lang, {})[word] = i
    return known


def _columns(n: int) -> list[str]:
    return [f"w{k}" for k in range(0, n, 2)]


def _buckets(n: int, maps, bits: int, least: int):
    """The buckets of the n-grams whose parts are frequent, in blocks: one for each occurrence, but of one bucket not more than ``least`` at once,
    which tell as much as all."""

    def work(batches):
        powers, held, size = Powers(), [], 0

        def blocks() -> pd.DataFrame:
            places = np.sort(np.concatenate(held))
            new = np.ones(len(places), bool)
            new[least:] = places[least:] != places[:-least]
            places = places[new]
            block = places >> np.uint32(_BLOCK_BITS)
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            inside = np.split((places & np.uint32((1 << _BLOCK_BITS) - 1)).astype("<u2"), first[1:])
            return pd.DataFrame({"block": block[first].astype(np.int64), "bit": pd.Series([part.tobytes() for part in inside], dtype=object)})

        for chunk in chunks(_texts(batches)):
            stream = Stream(chunk, powers)
            at = np.flatnonzero(stream.frequent(n, maps.value, np.ones(stream.words, bool)) & stream.own)
            held.append((stream.keys(at, n) & np.uint64(bits - 1)).astype(np.uint32))
            size += len(at)
            if size > KEPT_PLACES:
                yield blocks()
                held, size = [], 0
        if size:
            yield blocks()

    return work


def _level(n: int, maps, words, complete: bool, screen=None):
    """n-grams by the numbers of their words, with counts. If not all frequent words have numbers, the other n-grams come as text."""

    def work(batches):
        powers, known, rest = Powers(), _numbered(words.value), Counter()
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _added_up(np.concatenate([c for c, _ in held], axis=1), np.concatenate([c for _, c in held]))

        def frame(columns, counts) -> pd.DataFrame:
            return pd.DataFrame({**dict(zip(_columns(n), columns, strict=True)), "lang": None, "rest": None, "n": counts})

        def texts() -> pd.DataFrame:
            langs, found = [lang for lang, _ in rest], [text.decode("utf-8", "surrogatepass") for _, text in rest]
            rows = pd.DataFrame({**{c: np.full(len(found), -1) for c in _columns(n)}, "lang": langs, "rest": found, "n": list(rest.values())})
            rest.clear()
            return rows

        for chunk in chunks(_texts(batches)):
            stream = Stream(chunk, powers)
            if n == 2:  # nearly every word is looked at
                numbers = stream.numbers(known)
                alive = numbers >= 0 if complete else np.ones(stream.words, bool)
                at = np.flatnonzero(stream.frequent(n, maps.value, alive) & stream.own)
            else:
                at = np.flatnonzero(stream.frequent(n, maps.value, np.ones(stream.words, bool)) & stream.own)
                if screen is not None:
                    at = at[_passes(stream.keys(at, n), screen.value)]
                needed = np.unique(at[:, None] + np.arange(n))
                numbers = np.full(stream.words, -1, np.int64)
                numbers[needed] = stream.numbers(known, needed)
            own = numbers[at[:, None] + np.arange(n)]
            whole = (own >= 0).all(axis=1)
            for w in [] if complete else at[~whole].tolist():  # if all frequent words have numbers, the others let a bitmap through by mistake
                rest[stream.names[stream.lang[w]], stream.text(w, n)] += 1
            held.append(_added_up(_packed(own[whole]), np.ones(int(whole.sum()), np.int64)))
            size += len(held[-1][1])
            if size > KEPT_COUNTS:
                held = [merged()]
                size = len(held[0][1])
                if size > KEPT_COUNTS // 2:
                    yield frame(*held[0])
                    held, size = [], 0
            if len(rest) > KEPT_TEXTS:
                yield texts()
        if held:
            yield frame(*merged())
        if rest:
            yield texts()

    return work


def _phrases(n: int, words):
    """Texts of frequent n-grams, and their fingerprints."""

    def work(batches):
        powers = Powers()
        for frame in batches:
            rows = []
            packed = np.stack([frame[c].to_numpy(np.int64) for c in _columns(n)])
            for pairs, lang, rest, count in zip(packed.T.tolist(), frame["lang"], frame["rest"], frame["n"].tolist(), strict=True):
                if pairs[0] >= 0:
                    numbers = [half for pair in pairs for half in (pair >> 32, pair & 0xFFFFFFFF)][:n]
                    lang, text = words.value[numbers[0]][0], b" ".join([words.value[i][1] for i in numbers])
                else:
                    text = rest.encode("utf-8", "surrogatepass")
                rows.append((lang, n, text.decode("utf-8", "surrogatepass"), count, key_of(lang, text, n, powers)))
            yield pd.DataFrame(rows, columns=["lang", "words", "phrase", "n", "key"])

    return work


def _word_keys(batches):
    powers = Powers()
    for frame in batches:
        yield pd.DataFrame({"key": [key_of(lang, word.encode("utf-8", "surrogatepass"), 1, powers) for lang, word in zip(frame["lang"], frame["phrase"])]}, dtype="int64")


def known_words(frequent: DataFrame) -> list[tuple[str, bytes]]:
    """The most frequent words, within ``KNOWN_BYTES``; counts are cut at powers of two."""
    cost = F.octet_length("phrase") + F.octet_length("lang") + _WORD_BYTES
    sizes = frequent.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.sum(cost).alias("bytes")).orderBy(F.desc("level"))
    least, total = 1 << 62, 0
    for row in sizes.collect():  # at most 64 rows
        total += row["bytes"]
        if total > KNOWN_BYTES:
            break
        least = 1 << row["level"]
    found = frequent.where(F.col("n") >= least).select("lang", "phrase").toPandas()
    return [(lang, word.encode("utf-8", "surrogatepass")) for lang, word in zip(found["lang"], found["phrase"], strict=True)]


def _bitmap_block(key, columns):
    block = np.zeros(1 << _BLOCK_BITS, np.uint8)
    block[np.array(columns[0], np.int64)] = 1
    yield key[0], np.packbits(block, bitorder="little").tobytes()


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A Bloom filter with two places for every key: 16 bits a key, at most 64 MB whatever the number of keys, made in blocks of 8 kB."""
    rows = max(1, keys.count())
    bits = min(MOST_BITS, max(1 << _BLOCK_BITS, 1 << (BITS_PER_KEY * rows - 1).bit_length()))
    places = keys.select(
        F.explode(F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))).alias("place")
    ).distinct()
    placed = places.select(F.shiftright("place", _BLOCK_BITS).alias("block"), F.col("place").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("bit"))
    return _of_blocks(placed, _bitmap_block, bits)


def _of_blocks(placed: DataFrame, work, bits: int) -> np.ndarray:
    bitmap = np.zeros(bits // 8, np.uint8)
    size = (1 << _BLOCK_BITS) // 8
    for row in map_groups(placed, ["block"], ["bit"], work, "block long, bits binary").toLocalIterator():
        bitmap[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def _screen_block(least: int):
    def work(key, columns):
        counts = np.zeros(1 << _BLOCK_BITS, np.int64)
        for part in columns[0]:
            counts += np.bincount(np.frombuffer(part, "<u2"), minlength=len(counts))
        yield key[0], np.packbits(counts >= least, bitorder="little").tobytes()

    return work


def _screen(rows: DataFrame, n: int, maps, occurrences: int, least: int) -> np.ndarray:
    """A bit for each bucket of fingerprints: whether the n-grams in it, all together, come to ``least``. ``occurrences`` is about how many there
    can be; a bucket gets ``SCREEN_LOAD`` of them, as long as the screen is within ``MOST_BITS`` (64 MB)."""
    least = max(1, least)
    bits = min(MOST_BITS, max(1 << _BLOCK_BITS, 1 << (occurrences // SCREEN_LOAD).bit_length()))
    return _of_blocks(rows.mapInPandas(_buckets(n, maps, bits, least), "block long, bit binary"), _screen_block(least), bits)


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, words, phrase, n: every phrase of up to ``longest`` words that occurs ``least`` times in a language; and one row for each language
    with ``words`` 0, no phrase and the number of all its words.

    A-Z are lowered; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; a phrase lies within a piece.
    Null texts are empty, a null lang is ``und``. Repeated rows count as often as they occur; an empty table gives no rows. Other columns
    are ignored. Texts of any length are read in parts of a megabyte that overlap by four words.
    """
    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    context = documents.sparkSession.sparkContext
    counted = rows.mapInPandas(_word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    counted = materialised(counted.where(f"phrase is null or n >= {least}"), "phrases-1")
    frequent = counted.where("phrase is not null")
    numbered = known_words(frequent)
    complete = len(numbered) == frequent.count()
    words = context.broadcast(numbered)
    maps: list[np.ndarray | None] = [None if complete else _bitmap(frequent.mapInPandas(_word_keys, "key long"))]
    found = counted.selectExpr("lang", "if(phrase is null, 0, 1) as words", "phrase", "n")
    for n in range(2, longest + 1):
        names = _columns(n)
        longs = ", ".join(f"{c} long" for c in names)
        shared, screen = context.broadcast(list(maps)), None
        if n > 2 and (occurrences := level.agg(F.sum("n")).first()[0] or 0) >= SCREENED_FROM:
            screen = context.broadcast(_screen(rows, n, shared, occurrences, least))
        partial = rows.mapInPandas(_level(n, shared, words, complete, screen), f"{longs}, lang string, rest string, n long")
        grouped = partial.groupBy(*names, "lang", "rest").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        level = grouped.mapInPandas(_phrases(n, words), "lang string, words int, phrase string, n long, key long")
        level = materialised(level, f"phrases-{n}")
        found = found.unionByName(level.drop("key"))
        if n < longest:
            maps.append(_bitmap(level.select("key")))
    return found


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of two and more words of each language.

    ``score`` is floor(1000 * a * n / (l * r)) at the worst cut into two parts, exactly; phrases that a longer one holds and that do not occur more
    often than it are left out. Order: score, a, both descending, then the bytes of the phrase. See ``frequent_phrases``.
    """
    spark = documents.sparkSession
    found = frequent_phrases(documents, least, longest)
    counts = found.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    counts = broadcast_if_light(counts)
    totals = broadcast_if_light(found.where("words = 0").select("lang", "n"))
    phrases = found.where("words > 1").selectExpr("lang", "words", "phrase", "n as a", "split(phrase, ' ', -1) as ws")
    cuts = phrases.selectExpr("lang", "phrase", "a", "words", "ws", "explode(sequence(1, words - 1)) as k").selectExpr(
        "lang", "phrase", "a", "k", "array_join(slice(ws, 1, k), ' ') as head", "array_join(slice(ws, k + 1, words), ' ') as tail"
    )
    scored = spark.sql(
        """
        with parted as (
          select c.lang, c.phrase, c.a, c.k, h.f as l, t.f as r, n.n
          from {cuts} c join {heads} h on h.lang = c.lang and h.part = c.head
          join {tails} t on t.lang = c.lang and t.part = c.tail join {totals} n on n.lang = c.lang)
        select *, (1000BD * cast(a as decimal(16, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as score
        from parted
        """,
        cuts=cuts, heads=counts, tails=counts, totals=totals,
    )
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where("words > 2").selectExpr(
        "lang", "a as f",
        "explode(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(ws, i, m), ' '))))) as phrase",
    )
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return spark.sql(
        f"""
        with kept as (
          select w.lang, w.phrase, w.a, w.cut.l as l, w.cut.r as r, w.n, w.cut.score as score
          from {{worst}} w left join {{around}} x on x.lang = w.lang and x.phrase = w.phrase
          where x.f is null or 100 * x.f < 100 * w.a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select lang, cast(rank as bigint) as rank, phrase, a, l, r, n, score from ranked where rank <= {int(top)}
        """,
        worst=worst, around=around,
    )
