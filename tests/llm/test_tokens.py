from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex

from llm_fixtures import make, odd_rows  # noqa: F401 - fixtures

from tallymark.llm import bpe, queries, rans
from tallymark.session import materialised, shared_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Hello  world, it's 12345 o'clock!\n\n  Ünïcödé x y 漢字 🙂🙂", " lead", "x" * 300, "don't <|endoftext|> '''s \t\r\n z",
         "aaaaaaa bbbb abababab zzzzzzzzz", "Donaudampfschifffahrtsgesellschaft", "\x85\x1c\x1dq"]


def library_of_ranks():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("known_bytes", [0, bpe.KNOWN_BYTES])
def test_bpe_equals_the_library(spark, make, odd_rows, monkeypatch, known_bytes):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", known_bytes)
    library = library_of_ranks()
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü漢") for _ in range(100_000))
    rows = [*odd_rows, *[(100 + i, t, "s", "en") for i, t in enumerate([*TEXTS, letters, "one " + letters[:2_000] + " end"])]]
    found = bpe.encode_and_decode(make(rows), RANKS, public_tokenizers.PATTERN).collect()
    texts = {hashlib.md5((t or "").encode()).digest(): t or "" for _, t, *_ in rows}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, texts[bytes(r["text_md5"])]) for r in found) == sorted((d is None, d or 0, t or "") for d, t, *_ in rows)
    for r in found:
        text = texts[bytes(r["text_md5"])]
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode_and_decode(make([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_many_distinct_words(spark, make):
    library = library_of_ranks()
    texts = [" ".join(f"w{(i * 7_919 + j) * 2_654_435_761 % 10**7:x}" for j in range(1_000)) for i in range(60)]
    found = bpe.encode_and_decode(make([(i, t, "s", "en") for i, t in enumerate(texts)]), RANKS, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_texts_are_looked_up_once_and_not_written_before_they_are_dealt(spark, make, monkeypatch, capsys):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 0)
    written = []
    monkeypatch.setattr(bpe, "materialised", lambda df, name, *more, **named: (written.append(name), materialised(df, name, *more, **named))[1])
    library = library_of_ranks()
    texts = ["Unzeitgem\u00e4\u00dfheit one Unzeitgem\u00e4\u00dfheit", "", "x" * (bpe.LONG_WORD_BYTES + 1)]
    found = bpe.encode(make([(i, t, "s", "en") for i, t in enumerate(texts)]), bpe.Ranks(RANKS), public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    assert sorted(written) == ["folded", "ranks"]
    found.explain()
    final = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_rare_words_are_folded_where_they_stand(spark, make, odd_rows, monkeypatch, capsys):
    """No text and no rare word is shuffled: only counts are, before the result is asked for."""
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 2_000)
    monkeypatch.setattr(bpe, "LATE_SHARE", 1)
    monkeypatch.setattr(bpe, "_WORDS_COUNTED", 50)
    monkeypatch.setattr(bpe, "_PARTS_KEPT", 20)
    monkeypatch.setattr(bpe, "_IDS_IN_BATCH", 300)
    monkeypatch.setattr(bpe, "_ROWS_AT_ONCE", 3)
    library = library_of_ranks()
    rare = [" ".join(f"Unzeitgem\u00e4\u00df{(i * 13 + j) % 60}heit w{(i + j) * 7_919 % 10**5:x}," for j in range(20)) for i in range(30)]
    odd = [" a b", "a b ", "a  b", "a\n b", "a \nb", "a\nb c\n", "a b\n", "a b\n", "\x85 x", "x\xa0y z", "it's 's 'll x", "long " + "xy" * bpe.LONG_WORD_BYTES + " end \u6f22\u5b57"]
    rows = [*odd_rows, *[(100 + i, t, "s", "en") for i, t in enumerate([*TEXTS, *odd, *rare])]]
    found = bpe.encode(make(rows).coalesce(1), bpe.Ranks(RANKS), public_tokenizers.PATTERN)
    texts = {hashlib.md5((t or "").encode()).digest(): t or "" for _, t, *_ in rows}
    ids = {bytes(r["text_md5"]): r["ids"] for r in found.collect()}
    assert ids == {digest: library.encode_ordinary(t) for digest, t in texts.items()}
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "hashpartitioning" not in plan and "RoundRobin" not in plan


def test_words_of_parts_are_counted_as_those_of_texts(spark, make):
    library = regex.compile(public_tokenizers.PATTERN)
    texts = ["one two two, it's", "x\ny z\n", "x\ny z\n", "once\n", "a once\n", "b  c", " d e", "f g ", "h \ni", "", None, "j\u3000k l"]
    counted = bpe.counted_words(make([(i, t, "s", "en") for i, t in enumerate(texts)]), bpe.Ranks(RANKS), public_tokenizers.PATTERN)
    assert {r["word"]: r["n"] for r in counted.collect()} == Counter(w for t in texts for w in library.findall(t or ""))


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_ids_are_dealt_packed(kind):
    rng = np.random.default_rng(3)
    for n in (0, 1, 1_000):
        raw = (50_000 * rng.random(n) ** 4).astype(kind).tobytes()
        assert bpe.unsqueezed(bpe.squeezed(raw, kind), kind).tobytes() == raw
    assert len(bpe.squeezed(raw, kind)) < 0.95 * len(raw)


def test_ids_of_words_are_kept_in_bytes(spark, make):
    ranks = bpe.Ranks(RANKS)
    long = "ab" * bpe.LONG_WORD_BYTES
    found = bpe.folded_words(make([(1, f"the Unzeitgem\u00e4\u00dfheit {long}", "s", "en")]), ranks, public_tokenizers.PATTERN).collect()
    library = library_of_ranks()
    assert {r["word"]: np.frombuffer(r["ids"], ">u2").tolist() for r in found} == {w: library.encode_ordinary(w) for w in ("the", " Unzeitgem\u00e4\u00dfheit", f" {long}")}
    with_null = spark.sql("select array(1, 65534) as a, array(1, null) as b").select(bpe.packed(bpe.F.col("a"), "<u4"), bpe.packed(bpe.F.col("b"), "<u2"))
    assert [x and bytes(x) for x in with_null.first()] == [b"\0\0\0\1\0\0\xff\xfe", None]


def test_ids_take_two_bytes_where_they_fit(spark, make, tmp_path):
    assert bpe.Ranks(RANKS).kind() == "<u2"
    for last, kind in ((65_534, "<u2"), (65_535, "<u4")):
        path = tmp_path / f"{last}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b if b < 255 else last}\n" for b in range(256)))
        ranks = bpe.Ranks(str(path))
        assert ranks.kind() == kind
        texts = ["abc de", "\u00ff \u00e9t\u00e9", ""]
        found = bpe.encode(make([(i, t, "s", "en") for i, t in enumerate(texts)]), ranks, public_tokenizers.PATTERN).collect()
        assert {r["doc_id"]: r["ids"] for r in found} == {i: list(t.encode()) for i, t in enumerate(texts)}


def test_heap_merges_equal_the_library():
    library = library_of_ranks()
    rng = random.Random(2)
    for size in (1, 2, 7, 60, 900):
        word = "".join(rng.choice("aabcdeéß漢") for _ in range(size))
        assert bpe.merge_long(word.encode(), library._mergeable_ranks) == library.encode_ordinary(word)


def test_token_files_equal_the_library(spark, make, odd_rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(WORD_MODEL)
    library.encode_special_tokens = True
    rows = [*odd_rows, *[(100 + i, t, "s", "en") for i, t in enumerate(TEXTS)]]
    folder = shared_folder(spark, "rans-test")
    rans.write_tokens(make(rows), folder, WORD_MODEL, end_id=1)
    found = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in rans.read_tokens(spark, folder).collect())
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows]
    key = lambda d: (d is not None, d or 0)
    assert [d for _, d, _ in found] == sorted((d for d, *_ in rows), key=key)
    place = 0
    for start, _, raw in found:
        assert start == place
        place += len(raw) // 4
    coded = lambda own: np.array(own, "<u4").tobytes()
    assert sorted(((d, raw) for _, d, raw in found), key=repr) == sorted(((d, coded(x)) for (d, *_), x in zip(rows, ids)), key=repr)
    digests = rans.read_tokens(spark, folder, digests_only=True).collect()
    assert {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in digests} == {(s, len(raw) // 4, zlib.crc32(raw)) for s, _, raw in found}


def test_special_tokens_in_texts_have_the_ids_of_the_library(spark, make, odd_rows, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(WORD_MODEL)
    special = ["don't <|endoftext|> z", "a<|endoftext|>b <|startoftext|><|endoftext|>!", "<|ENDOFTEXT|> Über<|startoftext|>\nx <|endoftext |>"]
    rows = [*odd_rows, *[(100 + i, t, "s", "en") for i, t in enumerate([*TEXTS, *special])]]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in rows]
    expected = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids]
    assert dict(ids)[100 + len(TEXTS)] == [847, 713, 49407, 345, 1]
    found = queries.queries()["op9_rans_tokens"](spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=repr) == sorted(expected, key=repr)


def test_kept_words_are_bounded_and_those_met_again_stay(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(WORD_MODEL)
    monkeypatch.setattr(rans, "_CACHED_WORDS", 100)
    with open(WORD_MODEL, encoding="utf-8") as file:
        tokenizer = rans.WordTokenizer(file.read(), "<u2", special_tokens=True)
    learned, learn = [], tokenizer._learn_new
    monkeypatch.setattr(tokenizer, "_learn_new", lambda new: (learned.extend(new), learn(new)))
    for i in range(20):
        text = "often, " + " ".join(f"w{i}x{j}" for j in range(60))
        assert np.frombuffer(tokenizer.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(tokenizer.words) + len(tokenizer.older) < 400
    assert learned.count("often,") == 1


def test_older_words_are_looked_up_and_not_gone_through(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(WORD_MODEL)
    monkeypatch.setattr(rans, "_CACHED_WORDS", 10)

    class Older(dict):
        def __iter__(self):
            raise AssertionError("every batch goes through all older words")

    with open(WORD_MODEL, encoding="utf-8") as file:
        tokenizer = rans.WordTokenizer(file.read(), "<u2", special_tokens=True)
    first, second = " ".join(f"w{i} Wort{i}, Zahl" for i in range(40)), "w3 Wort7, new?! Zahl ... Zahl."
    for text in (first, second):
        assert np.frombuffer(tokenizer.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
        tokenizer.words = Older(tokenizer.words)
    assert "w3" in tokenizer.words and "w4" not in tokenizer.words


def test_empty_token_files(spark, make):
    folder = shared_folder(spark, "rans-test")
    rans.write_tokens(make([]), folder, WORD_MODEL, end_id=1)
    assert rans.read_tokens(spark, folder).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, rans.SEGMENT - 1, rans.SEGMENT, 2 * rans.SEGMENT + 777])
def test_coding_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 4999).astype("<u2")
    freq = rans.frequencies(np.bincount(np.append(ids, 1), minlength=5000))
    assert freq.sum() == 1 << rans.TABLE_BITS and (freq[np.unique(ids)] > 0).all()
    block = rans.encode_block(ids, freq, pad=1)
    symbol = np.repeat(np.arange(5000, dtype=np.uint32), freq)
    assert (rans.decode_block(**block, freq=freq, symbol=symbol) == ids).all()
    if n > rans.SEGMENT:
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert len(block["words"]) + len(block["states"]) < 1.1 * entropy
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_block(**(block | {"checksum": block["checksum"] ^ 1}), freq=freq, symbol=symbol)


def test_frequencies_of_few_and_many_ids():
    assert rans.frequencies(np.zeros(5, int)).sum() == 0
    assert rans.frequencies(np.array([0, 3, 0])).tolist() == [0, 1 << rans.TABLE_BITS, 0]
    many = rans.frequencies(np.concatenate([np.ones(60_000, int), [10**12]]))
    assert many.sum() == 1 << rans.TABLE_BITS and many.min() == 1
