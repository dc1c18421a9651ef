from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from llm_fixtures import make, odd_rows  # noqa: F401 - fixtures

from tallymark.llm import dedup, fingerprints

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows, percent):
    """Brute force over rows (doc_id, text): the smallest id of each row's component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return [(doc, len(sets[i]), ids.get(find(i))) for i, (doc, _) in enumerate(rows)]


def edited_copies(seed, families, copies):
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(families):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 160))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((doc, " ".join(own)))
            doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent, monkeypatch):
    rows = edited_copies(percent, 12, 14)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(components(rows, percent))
    found = dedup.near_duplicates(df, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == expected
    assert len({c for *_, c in expected}) > 12  # some copies are beyond the threshold
    monkeypatch.setattr(dedup, "CHUNK_MEMBERS", 3)  # buckets in several chunks give the same
    found = dedup.near_duplicates(df, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == expected


def test_odd_documents(make, odd_rows):
    rows = [(d, t) for d, t, *_ in odd_rows]
    found = dedup.near_duplicates(make(odd_rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == sorted(components(rows, 85), key=repr)
    kept = dedup.without_near_duplicates(make(odd_rows))
    assert kept.columns == make(odd_rows).columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(left) == len(set(left)) and (1, odd_rows[0][1]) in left and (2, odd_rows[1][1]) not in left
    assert (None, "other words here") in left and (4, None) in left
    assert dedup.near_duplicates(make([])).count() == 0 and dedup.without_near_duplicates(make([])).count() == 0


def test_one_row_of_each_component_stays_whatever_its_ids(make):
    one, other = "the cat sat on a mat while dogs ran", "green hills near blue water and old stones"
    rows = [(1, one), (1, other), (2, one), (3, other), (None, "Null ids only of one text"), (None, "null ids  only of one text"), (4, None), (4, "")]
    left = [(r["doc_id"], r["text"]) for r in dedup.without_near_duplicates(make([(*r, "a", "en") for r in rows])).collect()]
    assert sorted(left, key=repr)[:4] == sorted([(1, one), (1, other), (4, None), (4, "")], key=repr)
    assert len(left) == 5 and len([t for d, t in left if d is None]) == 1


def test_signature_is_a_shifted_permutation():
    sets = dedup.shingle_sets([b"a b c d e f g", b"A B c d e f g", b"one", b""])
    assert sets[0].tolist() == sets[1].tolist() and len(sets[0]) == 3 and len(sets[2]) == 1 and len(sets[3]) == 0
    marks = dedup.signatures(sets[:3], 10)
    assert (marks[0] == marks[1]).all() and marks.shape == (3, 10)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    agreement = (np.equal(*dedup.signatures([np.sort(a), np.sort(b)], 512))).mean()
    assert abs(agreement - 900 / 1100) < 0.08


def test_edited_texts_and_likeness(spark, make, odd_rows):
    rows = [(i, " ".join(f"w{(i * 7919 + j * 104729) % 5003}" for j in range(200))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()}
    for i, (doc, text) in enumerate(rows):
        following = rows[i - 1][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert found[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[doc]["n_chars"] == len(text)
        assert found[doc]["near_edited"] > 0.15 > found[doc]["near_next"]
    odd = fingerprints.edited_fingerprints(make(odd_rows)).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["near_edited"] <= 1 for r in odd)
    same = {r["fingerprint"] for r in odd if r["doc_id"] == 1 or (r["doc_id"] == 2 and r["n_chars"] == len(odd_rows[1][1]))}
    assert len(same) == 1
    alone = fingerprints.edited_fingerprints(make([(3, "just one text", "a", "en")])).first()
    assert alone["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(make([])).count() == 0


def test_fingerprint_is_sensitive_to_order(spark):
    words = [f"w{i * 37 % 1009}" for i in range(300)]
    blocks = [words[i : i + 10] for i in range(0, 300, 10)]
    moved = [w for block in blocks[::-1] for w in block]
    df = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join([*words[:-3], "x", "y", "z"]))], "a string, b string, c string")
    a, b, c = (fingerprints.fingerprint(df[x]) for x in "abc")
    row = df.select(fingerprints.likeness(a, b).alias("moved"), fingerprints.likeness(a, c).alias("edited"), fingerprints.likeness(a, a).alias("same")).first()
    assert row["same"] == 1.0 and row["edited"] > 0.9 and row["moved"] < 0.85


def test_next_document_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_IN_BUCKET", 3)
    rows = [(i * i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprints.with_next(fingerprints.in_ranges(df), ["text"]).collect()
    ordered = sorted(rows, reverse=True)
    expected = {d: ordered[(i + 1) % 50][1] for i, (d, _) in enumerate(ordered)}
    assert {r["doc_id"]: r["next_text"] for r in found} == expected


def test_ranges_hold_equal_numbers_wherever_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_IN_BUCKET", 16)
    rows = [(i, f"t{i}") for i in range(200)] + [(10**15, "far")] + [(None, f"none {i}") for i in range(90)] + [(-(2**63), f"same id {i}") for i in range(90)]
    ranged = fingerprints.in_ranges(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r["count"] for r in ranged.groupBy("__bucket").count().collect()]
    assert len(sizes) == -(-len(rows) // 16) and max(sizes) <= 17
    found = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(ranged, ["text"]).collect()]
    assert sorted(t for _, t, _ in found) == sorted(t for *_, t in found) == sorted(t for _, t in rows)  # one ring
    of_id = {t: d for d, t in rows}
    by_text = {t: of_id[following] for _, t, following in found}
    assert by_text["far"] == 199 and [by_text[f"t{i}"] for i in range(1, 200)] == list(range(199))
    assert by_text["t0"] == -(2**63) and sum(by_text[f"none {i}"] == 10**15 for i in range(90)) == 1
    monkeypatch.setattr(fingerprints, "MOST_BUCKETS", 4)
    assert fingerprints.in_ranges(spark.createDataFrame(rows, "doc_id long, text string")).select("__bucket").distinct().count() == 4


def plain_fingerprint(text, k=2, size=2):
    """Order MinHash spelled out, with the public hash of the engine (seed 42, chained over values)."""
    xxhash = pytest.importorskip("xxhash")

    def chained(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    long = lambda v: v.to_bytes(8, "little", signed=True)
    words = [chained(w.encode()) for w in re.findall(fingerprints.WORD, text, re.ASCII)]
    seen, bins = {}, {}
    for p in range(len(words)):
        g = chained(*map(long, words[p : p + k]))
        n = seen[g] = seen.get(g, -1) + 1
        g = g if n == 0 else chained(long(g), (n - 1).to_bytes(4, "little"))
        bins.setdefault(g >> 58, []).append((g, p))
    entries = []
    for number, own in sorted(bins.items()):
        value = chained(*(long(g) for _, g in sorted((p, g) for g, p in sorted(own)[:size])))
        entries.append(((number << 48) | (value & ((1 << 48) - 1))) & ((1 << 64) - 1))
    return "".join(f"{e:016X}" for e in entries)


def test_fingerprint_equals_a_plain_order_minhash(spark):
    rng = random.Random(8)
    texts = ["", "one", "a b", "a a a a a b a a", "漢字 x กข あ", "\n tabs\tand  blanks "]
    texts += [" ".join(f"w{rng.randrange(spread)}" for _ in range(rng.randrange(1, 400))) for spread in (3, 20, 500, 10**6) for _ in range(6)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", fingerprints.fingerprint_text(fingerprints.fingerprint(df["text"])).alias("f")).collect()
    assert [r["f"] for r in found] == [plain_fingerprint(r["text"]) for r in found]
