"""Token ids in files coded by a static range asymmetric numeral system (rANS).

A folder holds ``table`` (the frequency table shared by all blocks), ``blocks`` and ``index`` (the number of ids before each block).
A block holds whole documents, in ascending doc_id order, and decodes alone. Its ids lie in segments; for each segment a
checkpoint (decoder states and place in the word stream) is stored, so segments decode in parallel, each on interleaved lanes.
Every block has a checksum of its ids.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import materialised

from .common import batches_of, broadcast_if_small

LANES = 64
STEPS = 256
SEGMENT = LANES * STEPS
BLOCK_IDS = 64 * SEGMENT
PARTITION_IDS = 4_000_000
TABLE_BITS = 20
_LOW = np.uint64(1 << 31)
_CACHED_WORDS = 700_000  # of each of two generations; about 250 bytes a word
_TEXT_CHARACTERS = 2_000_000
_WORDS_AT_ONCE = 512
_LETTERS_AND_SIGNS = re.compile(r"^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)$", re.MULTILINE)
_LEAVE_SMALL_LETTERS = {"NFC", "Replace", "Lowercase"}  # normalisers that change no word of small Latin letters


# ---- tokenizing --------------------------------------------------------------------------------------------------


def _worker_cache() -> types.ModuleType:
    """What a Python worker keeps between tasks: tokenizers by their definition, and the ids of words."""
    return sys.modules.setdefault("__tallymark_tokens", types.ModuleType("__tallymark_tokens"))


class WordTokenizer:
    """The library's ids of texts, looked up word by word.

    The tokenizers this is for drop white space before they merge, and so never join what a blank or a line feed separates: the ids of a text are those of its words, which are kept in two generations: a full one becomes the older one, and what is met again moves on.
    Special tokens hold neither; with ``special_tokens`` one that stands in a text is its own id, as by the library's default, else it is read
    like other text.
    """

    def __init__(self, definition: str, kind: str, special_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = not special_tokens
        self.kind = np.dtype(kind)
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.of_letters = self._for_letters(definition)

    def _for_letters(self, definition: str):
        """The same merges without the normaliser and the pattern, where neither changes or parts a word of small Latin letters."""
        from tokenizers import Tokenizer, pre_tokenizers

        parts = json.loads(definition)
        normalizer, splitter = parts["normalizer"] or {"type": "Sequence", "normalizers": []}, parts["pre_tokenizer"] or {}
        steps = normalizer.get("normalizers", [normalizer])
        leaves = all(
            step["type"] in _LEAVE_SMALL_LETTERS and (step["type"] != "Replace" or step["pattern"] == {"Regex": r"\s+"}) for step in steps
        )
        of_bytes = [step["type"] for step in splitter.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        if not (leaves and of_bytes and r"[\p{L}]+" in str(splitter["pretokenizers"][0]["pattern"].get("Regex"))):
            return self.library
        plain = Tokenizer.from_str(definition)
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        return plain

    def _learn_letters(self, words: list[str]) -> None:
        """Words of small letters are encoded many at a time, and parted at the tokens that end a word."""
        groups = [words[at : at + _WORDS_AT_ONCE] for at in range(0, len(words), _WORDS_AT_ONCE)]
        coded = self.of_letters.encode_batch_fast([" ".join(some) for some in groups], add_special_tokens=False)
        size = self.kind.itemsize
        for some, found in zip(groups, coded, strict=True):
            ids = np.array(found.ids, self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                self.words.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:
                self._one_by_one(some)

    def _one_by_one(self, words: list[str]) -> None:
        for w, found in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.words[w] = np.array(found.ids, self.kind).tobytes()

    def _learn_new(self, new: set[str]) -> None:
        """Latin letters with ASCII signs behind them are two pieces, and capitals are read as small letters, so the parts are learned."""
        known = self.words
        parts = [(core + signs, core.lower(), signs) for core, signs in _LETTERS_AND_SIGNS.findall("\n".join(new))]
        if not parts:
            self._one_by_one(list(new))
            return
        wholes, small, signs = zip(*parts, strict=True)
        self._learn_letters(list(set(small).difference(known)))
        self._one_by_one(list(new.difference(wholes).union(signs).difference(known)))
        known.update(zip(wholes, map(add, map(known.__getitem__, small), map(known.__getitem__, signs)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > _CACHED_WORDS:
            self.words, self.older = {"": b""}, self.words
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.words)
        met_again = [w for w in new if w in self.older]  # intersection() would go through all older words
        self.words.update(zip(met_again, map(self.older.__getitem__, met_again), strict=True))
        new.difference_update(met_again)
        if new:
            self._learn_new(new)
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


def _tokens(definition: str, end_id: int, symbols: int, kind: str, special_tokens: bool):
    def work(batches):
        kept = _worker_cache()
        name = (zlib.crc32(definition.encode()), kind, special_tokens)
        if getattr(kept, "name", None) != name:
            kept.name, kept.tokenizer = name, WordTokenizer(definition, kind, special_tokens)
        end = np.array([end_id], kind).tobytes()
        counts = np.zeros(symbols, np.int64)
        for frame in batches:
            pairs = list(zip(frame["doc_id"], ["" if t is None else t for t in frame["text"]], strict=True))
            for part in batches_of(pairs, [len(t) for _, t in pairs], _TEXT_CHARACTERS):
                ids = [x + end for x in kept.tokenizer.encode([t for _, t in part])]
                counts += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=symbols)
                doc_ids = pd.array([None if pd.isna(d) else int(d) for d, _ in part], dtype="Int64")
                yield pd.DataFrame({"doc_id": doc_ids, "ids": ids, "counts": [None] * len(part)})
        yield pd.DataFrame({"doc_id": pd.array([None], dtype="Int64"), "ids": [None], "counts": [counts.tobytes()]})

    return work


def _summed(symbols: int):
    def work(batches):
        total = np.zeros(symbols, np.int64)
        for frame in batches:
            for counts in frame["counts"]:
                total += np.frombuffer(counts, np.int64)
        yield pd.DataFrame({"counts": [total.tobytes()]})

    return work


# ---- coding ------------------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Counts scaled to add up to ``2**bits``, at least 1 for every id that occurs; more ids than that are an error."""
    total = int(counts.sum())
    if np.count_nonzero(counts) > 1 << bits:
        raise ValueError(f"a table of {bits} bits holds no more than {1 << bits} distinct ids")
    scaled = np.where(counts > 0, np.maximum(1, counts * (1 << bits) // max(1, total)), 0).astype(np.int64)
    excess = int(scaled.sum()) - (1 << bits)
    order = np.argsort(-scaled, kind="stable")
    while excess and total:
        for i in order:
            change = min(excess, int(scaled[i]) - 1, max(1, int(scaled[i]) // 8)) if excess > 0 else excess
            if scaled[i] == 0 or change == 0:
                break
            scaled[i] -= change
            excess -= change
            if not excess:
                break
    return scaled


def encode_segments(ids: np.ndarray, freq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Code an array (segments, steps, lanes); returns the states (segments, lanes) and the word stream of each segment."""
    segments, steps, lanes = ids.shape
    state = np.full((segments, lanes), _LOW, np.uint64)
    limit = np.uint64(63 - TABLE_BITS)
    words, masks = [], []
    for i in range(steps - 1, -1, -1):
        f = freq[ids[:, i]]
        full = state >= f << limit
        words.append((state[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        masks.append(full.sum(axis=1))
        state[full] >>= np.uint64(32)
        quotient, rest = np.divmod(state, f)
        state = (quotient << np.uint64(TABLE_BITS)) + rest + first[ids[:, i]]
    by_segment = np.array(masks[::-1])
    owner = np.repeat(np.tile(np.arange(segments), steps), by_segment.ravel())
    stream = np.concatenate(words[::-1])
    order = np.argsort(owner, kind="stable")
    cuts = np.cumsum(by_segment.sum(axis=0))[:-1]
    return state, np.split(stream[order], cuts)


def decode_segments(
    state: np.ndarray, stream: np.ndarray, start: np.ndarray, steps: int, freq: np.ndarray, first: np.ndarray, symbol: np.ndarray
) -> np.ndarray:
    """The ids (segments, steps, lanes) from the checkpoints: states, and the place of each segment in the word stream."""
    segments, lanes = state.shape
    out = np.empty((segments, steps, lanes), symbol.dtype)
    mask, state, at = np.uint64((1 << TABLE_BITS) - 1), state.copy(), start.astype(np.int64).copy()
    for i in range(steps):
        slot = state & mask
        out[:, i] = found = symbol[slot]
        state = freq[found] * (state >> np.uint64(TABLE_BITS)) + slot - first[found]
        empty = state < _LOW
        place = np.cumsum(empty, axis=1, dtype=np.int32)
        read = (at[:, None] + place - 1)[empty]
        state[empty] = (state[empty] << np.uint64(32)) | stream[read].astype(np.uint64)
        at += place[:, -1]
    return out


def _firsts(freq: np.ndarray) -> np.ndarray:
    return (np.cumsum(freq) - freq).astype(np.uint64)


def encode_block(ids: np.ndarray, freq: np.ndarray, pad: int) -> dict:
    """Whole segments go together; what is left is one shorter segment, filled up with ``pad`` to whole steps."""
    f, first = freq.astype(np.uint64), _firsts(freq)
    whole = len(ids) // SEGMENT
    states, streams = [], []
    rest = ids[whole * SEGMENT :]
    steps = -(-len(rest) // LANES)
    filled = np.concatenate((rest, np.full(steps * LANES - len(rest), pad, ids.dtype)))
    for part in (ids[: whole * SEGMENT].reshape(whole, STEPS, LANES), filled.reshape(1, steps, LANES)):
        if part.size:
            state, stream = encode_segments(part, f, first)
            states.append(state)
            streams += stream
    return {
        "n": len(ids),
        "states": np.concatenate(states).astype("<u8").tobytes(),
        "places": np.concatenate(([0], np.cumsum([len(s) for s in streams])[:-1])).astype("<i8").tolist(),
        "words": np.concatenate(streams).astype("<u4").tobytes(),
        "checksum": zlib.crc32(ids.astype("<u4").tobytes()),
    }


def decode_block(n: int, states: bytes, places, words: bytes, checksum: int, freq: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    f, first = freq.astype(np.uint64), _firsts(freq)
    state, stream = np.frombuffer(states, "<u8").reshape(-1, LANES), np.frombuffer(words, "<u4")
    places = np.asarray(places, np.int64)
    whole = n // SEGMENT
    parts = []
    if whole:
        parts.append(decode_segments(state[:whole], stream, places[:whole], STEPS, f, first, symbol).ravel())
    if n % SEGMENT:
        steps = -(-(n % SEGMENT) // LANES)
        parts.append(decode_segments(state[whole:], stream, places[whole:], steps, f, first, symbol).ravel()[: n % SEGMENT])
    ids = np.concatenate(parts).astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("a block of token ids does not have its checksum")
    return ids


_BLOCK = (
    "part int, block long, doc_ids array<long>, doc_ns array<long>, n long, states binary, places array<long>, words binary, checksum long"
)


def _encode_partition(freq: np.ndarray, kind: str, pad: int):
    def work(batches):
        from pyspark import TaskContext

        _worker_cache().__dict__.clear()  # this worker may have been one that tokenized
        part, block, doc_ids, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        size = np.dtype(kind).itemsize

        def closed() -> pd.DataFrame:
            coded = encode_block(np.frombuffer(b"".join(ids), kind), freq, pad)
            own = {"part": part, "block": block, "doc_ids": list(doc_ids), "doc_ns": [len(x) // size for x in ids]}
            return pd.DataFrame([own | coded])

        for frame in batches:
            for doc_id, own in zip(frame["doc_id"], frame["ids"], strict=True):
                if ids and held + len(own) // size > BLOCK_IDS:
                    yield closed()
                    block, doc_ids, ids, held = block + 1, [], [], 0
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                ids.append(own)
                held += len(own) // size
        if ids:
            yield closed()

    return work


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int, special_tokens: bool = False) -> None:
    """Encode every whole text (null: empty) with the tokenizer, append ``end_id``, and write all ids in ascending doc_id order.

    A null doc_id comes first; rows that repeat a doc_id follow each other. Counts of the frequency table cover all ids. Other columns
    are ignored. An empty table gives an archive without blocks. ``special_tokens`` is the library's default for special tokens in texts;
    without it they are read like other text.
    """
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    from tokenizers import Tokenizer

    symbols = max(Tokenizer.from_str(definition).get_vocab(with_added_tokens=True).values()) + 1
    kind = "<u2" if symbols <= 1 << 16 else "<u4"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = materialised(
        rows.mapInPandas(_tokens(definition, end_id, symbols, kind, special_tokens), "doc_id long, ids binary, counts binary").withColumn(
            "place", F.monotonically_increasing_id()
        ),
        "tokens",
    )
    partial = tokens.where("counts is not null").select("counts").coalesce(16).mapInPandas(_summed(symbols), "counts binary")
    counts = sum((np.frombuffer(r["counts"], np.int64) for r in partial.collect()), np.zeros(symbols, np.int64))
    freq = frequencies(counts)
    spark.range(1).select(
        F.lit(kind).alias("kind"), F.lit(bytearray(freq.astype("<u4").tobytes())).alias("frequencies")
    ).write.parquet(f"{folder}/table")
    parts = max(1, -(-int(counts.sum()) // PARTITION_IDS))
    ordered = (
        tokens.where("counts is null").select("doc_id", "place", "ids")
        .repartitionByRange(parts, "doc_id", "place")
        .sortWithinPartitions("doc_id", "place")
    )
    ordered.mapInPandas(_encode_partition(freq, kind, end_id), _BLOCK).write.parquet(f"{folder}/blocks")
    sizes = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").select("part", "block", "n")
    spark.sql(
        """
        with parts as (
          select part, coalesce(sum(sum(n)) over (order by part rows between unbounded preceding and 1 preceding), 0) as before
          from {sizes} group by part)
        select part, block, before + coalesce(
            sum(n) over (partition by part order by block rows between unbounded preceding and 1 preceding), 0) as start
        from {sizes} join parts using (part)
        """,
        sizes=sizes,
    ).write.parquet(f"{folder}/index")


def _decode(freq: np.ndarray):
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)

    def work(batches):
        for frame in batches:
            for row in frame.itertuples(index=False):
                ids = decode_block(row.n, row.states, row.places, row.words, row.checksum, freq, symbol)
                ends = np.cumsum(np.asarray(row.doc_ns, np.int64))
                begins = ends - row.doc_ns
                raw = ids.astype("<u4").tobytes()
                doc_ids = pd.array([None if d is None or pd.isna(d) else int(d) for d in row.doc_ids], dtype="Int64")
                own = [raw[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)]
                yield pd.DataFrame({"doc_id": doc_ids, "start": begins + row.start, "ids": own})

    return work


def _digests(decoded):
    def work(batches):
        for frame in decoded(batches):
            n = frame["ids"].map(len) // 4
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"], "start": frame["start"], "n_tokens": n, "ids_crc32": frame["ids"].map(zlib.crc32)}
            )

    return work


def read_tokens(spark: SparkSession, folder: str, digests_only: bool = False) -> DataFrame:
    """doc_id, start (ids before the document) and its ids (32-bit little-endian), or their number and CRC-32 instead."""
    coded = spark.read.parquet(f"{folder}/table").first()["frequencies"]
    decoded = _decode(np.frombuffer(coded, "<u4").astype(np.int64))
    index = spark.read.schema("part int, block long, start long").parquet(f"{folder}/index")
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").join(broadcast_if_small(index), ["part", "block"])
    if digests_only:
        return blocks.mapInPandas(_digests(decoded), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return blocks.mapInPandas(decoded, "doc_id long, start long, ids binary")
