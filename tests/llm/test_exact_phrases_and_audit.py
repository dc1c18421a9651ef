from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import make, odd_rows  # noqa: F401

from tallymark.llm import divergence, exact, phrases

SPACE = re.compile("[\x20\x09-\x0d]+")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# ---- exact duplicates ----------------------------------------------------------------------------------------------


def equal_groups(rows):
    """(doc_id, keep_id, group_size) of every row; and how often each text is kept."""
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(((m[3], min(own)[3], len(own)) for own in groups.values() for m in own), key=repr), len(groups)


@pytest.mark.parametrize("hot_rows", [1, 10_000])
def test_exact_duplicates_of_odd_rows(make, odd_rows, hot_rows):
    rows = odd_rows + [(20 + i, "A B" if i % 2 else "A  B", "a", "en") for i in range(9)] + [(40, "AB\n", "x", None), (41, "A B C", None, "en")]
    found = exact.exact_duplicates(make(rows), {"n": F.length("text")}, hot_rows).collect()
    expected, groups = equal_groups(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=repr) == expected
    assert sum(r["kept"] for r in found) == groups and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    assert Counter(r["n"] for r in found) == Counter(None if t is None else len(t) for _, t, *_ in rows)


def test_texts_that_only_differ_behind_the_prefix(make):
    base = "x" * (exact.PREFIX_CHARACTERS + 5)
    rows = [(1, base + "a"), (2, base + "b"), (3, base + " a"), (4, base[:-1] + "ya")]
    found = exact.exact_duplicates(make([(*r, "s", "en") for r in rows])).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in found) == [(1, 3), (2, 2), (3, 3), (4, 4)]


def test_exact_duplicates_without_broadcasts(make, odd_rows, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    found = exact.exact_duplicates(make(odd_rows)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=repr) == equal_groups(odd_rows)[0]


def test_exact_duplicates_of_no_rows(make):
    assert exact.exact_duplicates(make([])).collect() == []


# ---- phrases -------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, _, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p in candidates:
            inside = any(len(q) > len(p) and f[q] >= f[p] and p in [q[i : i + len(p)] for i in range(len(q) - len(p) + 1)] for q in candidates)
            if not inside:
                score, k = min((1000 * f[p] * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def wordy_rows(seed: int, n: int):
    """Texts that repeat some runs of words, with blanks and signs of many kinds between words."""
    rng = random.Random(seed)
    words = ["ab", "Ab", "c", "Ünd", "d\x00", "漢字", "e-f", "g", "x y"]
    runs = [["ab", "c", "g"], ["g", "g", "g", "g", "g", "g"], ["e-f", "漢字", "c", "ab", "Ünd"]]
    rows = []
    for i in range(n):
        own = [w for _ in range(rng.randint(0, 12)) for w in (rng.choice(runs) if rng.random() < 0.5 else [rng.choice(words)])]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\x0b"]) for w in own)
        rows.append((i, text, "s", rng.choice(["en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_collocations_match_brute_force(make, odd_rows, monkeypatch, chunk):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", chunk)
    rows = wordy_rows(5, 120) + odd_rows
    found = phrases.collocations(make(rows), least=4, top=20).collect()
    assert sorted(tuple(r) for r in found) == plain_collocations(rows, 4, 20)


def test_phrases_survive_colliding_fingerprints(make, monkeypatch):
    monkeypatch.setattr(phrases, "_mix", lambda x: x & np.uint64(7))
    rows = wordy_rows(6, 60)
    assert sorted(tuple(r) for r in phrases.collocations(make(rows), least=4, top=50).collect()) == plain_collocations(rows, 4, 50)


@pytest.mark.parametrize("known_bytes", [0, 250, 1 << 20])
def test_collocations_with_words_that_have_no_number(make, odd_rows, monkeypatch, known_bytes):
    monkeypatch.setattr(phrases, "KNOWN_BYTES", known_bytes)
    monkeypatch.setattr(phrases, "KEPT_COUNTS", 5)
    monkeypatch.setattr(phrases, "KEPT_TEXTS", 3)
    rows = wordy_rows(7, 80) + odd_rows
    found = phrases.collocations(make(rows), least=4, top=40).collect()
    assert sorted(tuple(r) for r in found) == plain_collocations(rows, 4, 40)


def test_tasks_hand_on_numbers_of_words_and_no_texts_of_phrases():
    class Held:
        def __init__(self, value):
            self.value = value

    frame = phrases.pd.DataFrame({"lang": ["en", "de"], "text": ["a b a b. a b", "a b"]})
    words = Held([("en", b"a"), ("en", b"b"), ("de", b"a"), ("de", b"b")])
    parts = list(phrases._level(2, Held([None]), words, True)(iter([frame])))
    assert sorted((r.w0 >> 32, r.w0 & 0xFFFFFFFF, r.n) for part in parts for r in part.itertuples()) == [(0, 1, 3), (1, 0, 1), (2, 3, 1)]
    assert all(part["rest"].isna().all() for part in parts)
    (texts,) = phrases._phrases(2, words)(iter(parts))
    assert sorted(zip(texts["lang"], texts["phrase"], texts["n"])) == [("de", "a b", 1), ("en", "a b", 3), ("en", "b a", 1)]
    stream = phrases.Stream([("en", b"a b", 3)], phrases.Powers())
    assert phrases.key_of("en", b"a b", 2, phrases.Powers()) == stream.keys(np.array([0]), 2).view(np.int64)[0]


@pytest.mark.parametrize("known_bytes", [250, 1 << 20])
def test_collocations_of_screened_phrases(make, odd_rows, monkeypatch, known_bytes):
    monkeypatch.setattr(phrases, "SCREENED_FROM", 0)
    monkeypatch.setattr(phrases, "KEPT_PLACES", 7)
    monkeypatch.setattr(phrases, "KNOWN_BYTES", known_bytes)
    rows = wordy_rows(8, 120) + odd_rows
    assert sorted(tuple(r) for r in phrases.collocations(make(rows), least=4, top=40).collect()) == plain_collocations(rows, 4, 40)


def test_rare_phrases_of_frequent_parts_are_not_counted(make, monkeypatch):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(30)}" if rng.random() < 0.95 else "w1 w2 w3" for _ in range(40_000))
    rows, real, handed_on = [(i, part, "s", "en") for i, part in enumerate([text[:100_000], text[100_000:]])], phrases._level, []

    def counted(n, *arguments):
        work, rows_of = real(n, *arguments), make([]).sparkSession.sparkContext.accumulator(0)
        handed_on.append(rows_of)

        def counting(batches):
            for frame in work(batches):
                rows_of.add(len(frame))
                yield frame

        return counting

    monkeypatch.setattr(phrases, "_level", counted)
    monkeypatch.setattr(phrases, "SCREENED_FROM", 1_000, raising=False)
    found = {r["phrase"]: r["n"] for r in phrases.frequent_phrases(make(rows), least=12, longest=3).collect() if r["words"] == 3}
    expected = Counter()
    for _, part, *_ in rows:
        words = part.split(" ")
        expected.update(zip(words, words[1:], words[2:]))
    assert found == {" ".join(p): n for p, n in expected.items() if n >= 12}
    assert len(found) <= handed_on[1].value < len(expected) / 5


def test_long_texts_are_cut_between_words():
    text = b"one two, three  " * 20
    parts = [own for chunk in phrases.chunks(iter([("en", text)])) for own in chunk]
    assert len(parts) == 1
    old, phrases.CHUNK_BYTES = phrases.CHUNK_BYTES, 30
    try:
        parts = [own for chunk in phrases.chunks(iter([("en", text), ("en", b"x" * 100), ("de", b"")])) for own in chunk]
    finally:
        phrases.CHUNK_BYTES = old
    assert b"".join(part[:own] for lang, part, own in parts) == text + b"x" * 100 and len(parts) > 8


def test_collocations_of_no_rows(make):
    assert phrases.collocations(make([])).collect() == []
    assert phrases.collocations(make([(1, None, None, None), (2, "", "a", "en")])).collect() == []


# ---- divergence ----------------------------------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, source, lang in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, d in documents[lang].items() if d >= least]
        groups = {s: c for (at, s), c in counts.items() if at == lang}
        everything = sum(groups.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))
        pairs = [(-sum(abs(share(own, t) - share(c, t)) for t in kept), s.encode(), s) for s, c in groups.items() if s != source]
        terms = [(share(everything, t) - share(own, t), t.encode(), t) for t in kept if own[t] and share(own, t) > share(everything, t)]
        out += [(lang, source, "pair", item, -value, rank) for rank, (value, _, item) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", item, -value, rank) for rank, (value, _, item) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("part_terms", [50_000, 3])
def test_divergence_matches_brute_force(make, odd_rows, part_terms):
    rng = random.Random(3)
    words = [a + b for a in ("un", "Ge", "é", "漢") for b in "abcdefgh"]
    rows = odd_rows + [
        (i, " 1,".join(rng.choice(words[(i % 5) :]) for _ in range(rng.randint(0, 30))), f"s{i % 7 if i % 3 else 0}", rng.choice(["en", "de", None]))
        for i in range(150)
    ]
    found = divergence.source_divergence(make(rows), least_documents=4, top=5, part_terms=part_terms).collect()
    assert sorted(tuple(r) for r in found) == plain_divergence(rows, 4, 5)


def test_divergence_without_kept_terms(make, odd_rows):
    found = divergence.source_divergence(make(odd_rows)).collect()
    assert sorted(tuple(r) for r in found) == plain_divergence(odd_rows, 30, 50)
    assert {r["value"] for r in found} == {0}
    assert divergence.source_divergence(make([])).collect() == []


def test_skyband_keeps_what_fewer_than_k_dominate():
    rng = np.random.default_rng(1)
    group, lang, place = rng.integers(0, 9, 300), rng.integers(0, 9, 300), rng.permutation(300)
    dominators = [np.sum((group >= group[i]) & (lang <= lang[i]) & (place < place[i])) for i in range(300)]
    for k in (1, 3, 10):
        assert sorted(divergence.skyband(group, lang, place, k)) == [i for i in range(300) if dominators[i] < k]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "_CHUNK_BYTES", 10)
    text = b"one two three " * 9 + b"x" * 50
    assert b"".join(divergence._parts_of(text)) == text
