"""Content-addressed archive of WARC records.

The archive is two tables in one folder: ``payloads`` holds the bytes of every
different payload once, under its SHA-256, and ``records`` holds the exact
header of each record.  Reading verifies the digests anew and joins the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(page.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _one_line(text: Column) -> Column:
    """A header value: percent-encoded controls and blanks, so that no value breaks a line."""
    encoded = F.coalesce(text.cast("string"), F.lit(""))
    for c in ("\r", "\n", " ", "\t"):
        encoded = F.replace(encoded, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return encoded


def _header(kind: Column, date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _record_id(F.col("first"))))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _record_id(F.col("page"))),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``).

    Of records with equal payloads of at least ``min_bytes``, that of the
    smallest page id is a response and the others revisit it; rows that repeat
    the smallest id are responses too.  A null html is the empty payload; a null page id sorts last (a response only
    if no other record has the payload); a null url is an empty target.

    Payloads meet only after a partial aggregation: each task sends one copy of a payload.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.max("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    light = rows.select("page", "url", "digest", F.octet_length("payload").cast("long").alias("n"))
    # Only digests of several records need the join; the rest are their own first.
    firsts = light.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    named = light.join(firsts, "digest", "left")
    kind = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), "revisit").otherwise("response")
    named.select("page", "digest", F.when(kind == "revisit", F.col("first")).alias("refers_to"), _header(kind, date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: page, header fields, exact header, and the payload of each, rebuilt by a join.

    ``verified`` is true where the stored bytes have the digest they are
    filed under; revisits get the payload that they refer to.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads").withColumns({"verified": F.sha2("payload", 256) == F.col("digest"), "payload_bytes": F.octet_length("payload").cast("long")})
    field = lambda name: F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    parsed = records.select("page", "refers_to", "header", field("WARC-Type").alias("record_type"), F.substring(field("WARC-Payload-Digest"), 8, 64).alias("digest"), field("WARC-Target-URI").alias("target"))
    return parsed.join(payloads, "digest")


def record_bytes(archive: DataFrame) -> DataFrame:
    """``page`` and the bytes of its WARC record: header, block (empty for a revisit) and the closing blank lines."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("page", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"))


def write_warc_files(archive: DataFrame, path: str) -> None:
    """Plain .warc text files, one per task, by Spark's text writer; payloads are UTF-8."""
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    archive.select(F.concat("header", block).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
