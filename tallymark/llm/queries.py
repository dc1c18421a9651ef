"""The queries ``opN_<name>``: each derives the columns of its contract from the real output of its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, dedup, divergence, exact, fingerprints, language, mixing, phrases, quality, rans, sharding, topk, warc
from tallymark.llm.common import table
from tallymark.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), "id % 20 = 0", 20)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit(documents, table(spark, sf_dir, "labels"))
    score = F.col("score")
    return quality.with_quality(documents, field, "score").select(
        "doc_id", quality.held_out().alias("held_out"), score, (score >= 0.5).cast("int").alias("predicted")
    )


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents)
    return language.with_language(documents.select("doc_id", "text"), model, "lang_pred", "score").select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score"
    )


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "rans")
    path = public_tokenizers.path("word_bpe_49k.json")
    rans.write_tokens(table(spark, sf_dir, "documents"), folder, path, end_id=1, special_tokens=True)
    return rans.read_tokens(spark, folder, digests_only=True)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"text_sha256": F.sha2(exact.normalised(), 256)}
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), also=digest)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
