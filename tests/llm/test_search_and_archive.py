from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tallymark.llm import topk, warc
from tallymark.session import shared_folder


def brute(vectors: dict, k: int, is_query):
    found = {}
    for q, v in vectors.items():
        if is_query(q):
            scores = [(-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q]
            found[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return found


def quantise(v):
    return [int(np.floor(64 * float(x))) for x in v]


def search(spark, rows, k=3, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "'x' as v", "2 as score")
    out = topk.exact_top_k(df, "id % 2 = 0", k, **options).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return found


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 37)).astype("float32")
    rows = [(i, [float(x) for x in base[i % 40] * (1 if i < 60 else 0.01)]) for i in range(150)]  # ties: repeated vectors
    expected = brute({i: quantise(np.float32(v)) for i, v in rows}, 3, lambda i: i % 2 == 0)
    assert search(spark, rows) == expected
    monkeypatch.setattr(topk, "CANDIDATES_IN_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", 20)
    assert search(spark, rows) == expected


def test_top_k_leaves_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [9.0, 9.0]),
            (7, [0.5]), (9, []), (1, [1.0, 1.0])]
    assert search(spark, rows, k=9) == {0: [(1, 12288), (7, 2048), (9, 0)]}
    assert search(spark, [(0, [1.0])]) == {}
    assert search(spark, []) == {}


def test_scores_stay_exact_beyond_doubles():
    q, c = [np.array([2**40, 3])], [np.array([2**20, 1]), np.array([2**20, 2]), np.array([2**40, 2**40])]
    found = topk.best_of_block(np.array([0]), q, np.array([1, 2, 3]), c, 3)
    assert found["score"].tolist() == [2**63 - 1, 2**60 + 6, 2**60 + 3] and found["vec_id"].tolist() == [3, 2, 1]


@pytest.fixture(scope="module")
def pages():
    big, other = "x" * 1000 + "é", "y" * 1500
    return [(1, "http://a/%0A", big), (5, "http://b", big), (3, None, big), (7, "u\r\nv", "short"), (8, "w", "short"), (9, "z", None),
            (10, "z", ""), (11, "z", other), (11, "z", other), (2, "z", other), (None, "n", big), (None, "n", "z" * 2000)]


def test_archive_round_trip(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload")
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(df, folder)
    records = warc.read_archive(spark, folder).collect()
    kept = {"x" * 1000 + "é": 5, "y" * 1500: 11}
    expected = []
    for page, url, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and html in kept and (page is None or page < kept[html])
        expected.append((page, url, hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", kept[html] if revisit else None, data))
    found = [(r["page_id"], r["url"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in records]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(p[2] or "") for p in pages})
    for r in records:
        body = b"" if r["record_type"] == "revisit" else bytes(r["payload"])
        assert bytes(r["record"]) == bytes(r["header"]) + body + b"\r\n\r\n"
        assert f"Content-Length: {len(body)}\r\n".encode() in bytes(r["header"]) and bytes(r["header"]).startswith(b"WARC/1.1\r\n")


def test_empty_archive(spark):
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archive(spark, folder).count() == 0


def test_damaged_payload_is_noticed(spark):
    folder = shared_folder(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc.write_archive(df, folder)
    stored = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "kept_page", "bytes", "cast('other' as binary) as payload").collect()
    schema = spark.read.parquet(f"{folder}/payloads").schema
    spark.createDataFrame(stored, schema).write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, folder).collect()
