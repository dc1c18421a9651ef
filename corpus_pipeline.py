"""From raw documents to token ids: quality, language, near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; its result is written as Parquet and
read again as the next one's ``docs``. Null ids, repeated rows, empty tables and further columns of any name go through all stages: a
row without text or letters goes at the language stage, repeated rows are near duplicates of each other, a row without id
stays if no other row has its text, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, dedup, language, mixing, quality
from tallymark.llm.common import table, unused
from tallymark.session import materialised

LEAST_QUALITY = 0.5
LEAST_LANGUAGE = 0.5
SIMILARITY_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field holds to be good; those without text have the share of good documents as their score."""
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = unused("quality_score", docs.columns)
    return quality.with_quality(docs, field, name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter go."""
    name, score = unused("language_name", docs.columns), unused("language_score", docs.columns)
    named = language.with_language(docs, language.fit(docs), name, score)
    return named.where((F.col(name) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).drop(name, score)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return dedup.without_near_duplicates(docs, SIMILARITY_PERCENT)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0 to 3 times)."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    same = F.unhex(F.md5("decoded")) == F.col("text_md5")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near duplicates", distinct_texts),
    ("mixing", mixed_sources),
    ("tokens", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
