from __future__ import annotations

import base64
from collections import Counter

import public_tokenizers
import pytest
from test_duplicates_and_fingerprints import components

import __spark_entry__ as registered
import corpus_pipeline
from tallymark.llm import language, mixing, oracle, quality, queries

DATA = "/root/testdata/sf0.001"


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_all_operators_are_registered():
    found = registered.queries()
    assert {int(name[2:].split("_")[0]) for name in queries.queries() if name.startswith("op")} == set(range(1, 14))
    assert set(queries.queries()) <= set(found) and "pipeline" in found
    assert set(oracle.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found = queries.queries()[name](spark, DATA)
    cursor = connection.execute(oracle.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparable(found.collect(), found.columns) == comparable(cursor.fetchall(), columns)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain version of its own, each on what the stage before it kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == before.columns

    before, after = kept["quality"]
    field = quality.fit(before, labels)
    rows = before.collect()
    good = [r["doc_id"] for r, s in zip(rows, field.scores([r["text"] for r in rows])) if s >= 0.5]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(good)

    before, after = kept["language"]
    rows = before.collect()
    names, scores = language.fit(before).predict([r["text"] for r in rows])
    known = [r["doc_id"] for r, n, s in zip(rows, names, scores) if n != "und" and s >= 0.5]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(known)

    before, after = kept["near duplicates"]
    expected = components([(r["doc_id"], r["text"]) for r in before.collect()], 80)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _, c in expected if d == c)

    before, after = kept["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({d: n for d, n in copies.items() if n})

    before, after = kept["tokens"]
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = {r["doc_id"]: library.encode_ordinary(r["text"]) for r in before.collect()}
    assert all(r["ids"] == encoded[r["doc_id"]] and r["round_trip"] for r in after.collect())
    assert after.count() == before.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Clashing names, null and repeated ids, repeated rows, and no rows at all."""
    good = spark.read.parquet(f"{DATA}/documents.parquet").limit(150)
    plain = [(None, "a clean text without any id stands here and has some words", "en", "x", 5), (None, None, None, None, None)]
    odd = good.unionByName(good.limit(10)).unionByName(spark.createDataFrame(plain, good.schema))
    odd = odd.selectExpr("*", "7 as __id", "8 as __hash", "9 as __quality", "'q' as quality_score", "1 as row", "'z' as __size", "2 as __copy", "3 as language_name")
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        folder = str(tmp_path / name)
        for stage, work in corpus_pipeline.STAGES:
            work(spark, docs, DATA).write.parquet(f"{folder}/{stage}")
            before, docs = docs, spark.read.parquet(f"{folder}/{stage}")
            if stage != "tokens":
                assert docs.columns == odd.columns
                assert docs.where("__id <> 7 or __hash <> 8 or __quality <> 9 or quality_score <> 'q' or row <> 1 or __copy <> 2").count() == 0
                assert docs.exceptAll(before.unionByName(before).unionByName(before)).count() == 0
        assert (docs.count() > 50) == (name == "odd")
