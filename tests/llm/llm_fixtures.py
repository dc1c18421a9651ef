from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source, lang) tuples, with columns whose names the operators use themselves."""

    def build(rows, schema="doc_id long, text string, source string, lang string"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "1 as key", "'x' as size", "2 as rank", "3 as score", "'y' as part", "4 as ids", "5 as bucket", "6 as copies")

    return build


WORDS = "the cat sat on a mat while dogs ran over green hills near blue water and old stones".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 97) for i in range(20_000))
    plain = " ".join(WORDS) + "."
    return [
        (1, plain, "a", "en"), (2, plain, "a", "en"), (2, plain, "a", "en"), (3, plain + " end", "b", "en"),
        (4, None, "b", "en"), (5, "", "b", None), (6, "   \n ", None, "en"), (7, long_text, "a", "en"),
        (None, plain, "a", "en"), (None, "other words here", None, None), (None, None, None, None),
        (8, "Ünïcödé 漢字 🙂 end", "c", "de"), (9, "one", "c", "de"), (10, "a b\tc\x0bd\x0ce\rf", "c", "de"),
        (2, "another text of the same id", "a", "en"), (-5, "negative id", "a", "en"), (2**62, "huge id", "a", "en"),
    ]
