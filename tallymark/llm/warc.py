"""Content-addressed WARC archive.

``payloads`` holds the bytes of each distinct payload once, under their SHA-256; ``records`` holds the exact header block of every
record and the digest of its payload. Original records are rebuilt by joining the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
_DATE = "1970-01-01T00:00:00Z"


def _one_line(text: Column) -> Column:
    """A header value: control characters, which would break the header block, are percent-encoded."""
    value = F.regexp_replace(F.coalesce(text, F.lit("")), "%", "%25")
    for character, code in (("\r", "%0D"), ("\n", "%0A")):
        value = F.regexp_replace(value, character, code)
    return value


def _record_name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write one record for each row of ``pages`` (page_id, url, html), the payload being ``html`` in UTF-8 (null: empty).

    Of records with equal payloads of at least ``revisit_bytes`` that with the largest page_id is a response, the others are
    revisits of it; smaller ones are all responses. Rows that share the largest page_id are all responses; a null page_id is
    smaller than any other, and equal payloads that only have null ids are all responses. Other columns are
    ignored. The digest is verified while writing: rows with equal SHA-256 must agree in length, SHA-1 and a third hash,
    else the job fails.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select(
        "*",
        F.unhex(F.sha2("payload", 256)).alias("digest"),
        F.sha1("payload").alias("sha1"),
        F.length("payload").cast("long").alias("bytes"),
    )
    check = F.struct("bytes", "sha1", F.xxhash64("payload").alias("other"))
    (
        rows.groupBy("digest")
        .agg(
            F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("at"), "page_id", "payload")).alias("kept"),
            F.min(check).alias("low"),
            F.max(check).alias("high"),
        )
        .select(
            F.when(F.col("low") == F.col("high"), F.col("digest"))
            .otherwise(F.raise_error(F.lit("different payloads have the same SHA-256")))
            .alias("digest"),
            F.col("kept.page_id").alias("kept_page"),
            F.col("low.bytes").alias("bytes"),
            F.col("kept.payload").alias("payload"),
        )
        .write.parquet(f"{folder}/payloads")
    )
    kept = spark.read.parquet(f"{folder}/payloads").where(F.col("bytes") >= revisit_bytes).select("digest", "kept_page")
    of = F.coalesce("page_id", F.lit(-(2**63)))
    is_revisit = F.col("kept_page").isNotNull() & (of < F.col("kept_page"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_name(F.col("page_id"))),
        line("WARC-Date", F.lit(_DATE)),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", _one_line(F.col("url")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(
            is_revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_name(F.col("kept_page"))),
            ),
        ).otherwise(""),
        line("Content-Length", F.when(is_revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    (
        rows.drop("payload")
        .join(kept, "digest", "left")
        .select("digest", F.encode(header, "UTF-8").alias("header"))
        .write.parquet(f"{folder}/records")
    )


def field(header: Column, name: str) -> Column:
    """The value of a header line; null if there is none."""
    found = F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(header.contains(f"\r\n{name}: "), found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its header block, its payload and the exact bytes of the WARC record (of a revisit: no payload).

    Columns: page_id, url, record_type, refers_to, payload_digest (SHA-1 of the header), header, payload, record. A payload that
    does not have the digest it is stored under, or not the SHA-1 of a record that names it, fails the job.
    """
    stored = spark.read.parquet(f"{folder}/payloads").select(
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("digest"))
        .otherwise(F.raise_error(F.lit("a stored payload does not have its digest")))
        .alias("digest"),
        "payload",
        F.sha1("payload").alias("sha1"),
    )
    records = spark.read.parquet(f"{folder}/records")
    text = F.decode("header", "UTF-8")
    page = lambda value: F.regexp_extract(value, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda value: F.when(value != "", value).cast("long")
    uri = field(F.col("h"), "WARC-Target-URI")
    for character, code in (("\r", "%0D"), ("\n", "%0A"), ("%", "%25")):
        uri = F.regexp_replace(uri, code, character)
    joined = records.join(stored, "digest").withColumn("h", text)
    digest = F.regexp_replace(field(F.col("h"), "WARC-Payload-Digest"), "^sha1:", "")
    kind = field(F.col("h"), "WARC-Type")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(
        number(page(field(F.col("h"), "WARC-Record-ID"))).alias("page_id"),
        uri.alias("url"),
        kind.alias("record_type"),
        number(page(field(F.col("h"), "WARC-Refers-To"))).alias("refers_to"),
        F.when(digest == F.col("sha1"), digest)
        .otherwise(F.raise_error(F.lit("a record names another payload digest than its payload has")))
        .alias("payload_digest"),
        "header",
        "payload",
        F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"),
    )
