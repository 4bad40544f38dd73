"""A content-addressed WARC archive: payload bytes once, exact record headers apart.

An archive is two tables. ``payloads(digest, payload)`` holds the bytes of every different payload once, addressed by
their SHA-256. ``headers(head, block_head, digest)`` holds what comes before the payload in every record: the WARC
header block and the start of the record's block, byte by byte. A record is put together by a join on the digest, and
the bytes found are hashed again, so that a damaged payload is an error and never a wrong record.

Payloads are reduced to one for each task before they are shuffled by digest. The join meets a payload that a third of
all records share as one row on one side, and adaptive execution splits the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
# Header names, versions and the profile of the WARC 1.1 standard; RFC 4648 base32 digits.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RADIX_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID_PREFIX = "urn:x-page:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary ``payload``: 40 bits give eight digits."""
    digest = F.sha1(payload)
    pieces = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*pieces), RADIX_DIGITS, BASE32_DIGITS)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _uri(url: Column) -> Column:
    """The address with line breaks and blanks percent-encoded, so that it stays on its line."""
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write an archive of ``pages(page_id, url, html)`` below the new folder ``path``, one record for each row.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest ``page_id`` is the
    response and the others are revisits of it; smaller payloads are responses throughout. A null html is an empty
    payload. A null id is smaller than any other; rows that repeat the largest id, or are all without id, are responses
    alike. A null url gives no target line. Other columns are ignored. An empty input gives an empty archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    facts = rows.select(
        "page_id", _uri(F.col("url")).alias("uri"), "digest", F.octet_length("payload").alias("size"), base32_sha1(F.col("payload")).alias("sha1")
    )
    first = (
        facts.where(F.col("size") >= min_bytes)
        .groupBy("digest")
        .agg(F.max_by("uri", "page_id").alias("first_uri"), F.max("page_id").alias("first_id"))
        .withColumn("shared", F.lit(True))
    )
    joined = facts.join(first, "digest", "left")
    response = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block_bytes = F.octet_length("block_head") + F.when(F.col("response"), F.col("size")).otherwise(0)
    head = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("response"), F.lit("")).otherwise(
            F.concat(
                _line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                _line("WARC-Refers-To", _record_id(F.col("first_id"))),
                _line("WARC-Refers-To-Target-URI", F.col("first_uri")),
                _line("WARC-Refers-To-Date", F.lit(date)),
            )
        ),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
    )
    (
        joined.select("*", response.alias("response"), http.alias("block_head"))
        .select(head.alias("head"), "block_head", "digest")
        .write.option("compression", "zstd").parquet(f"{path}/headers")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(head, block_head, digest, payload)``: every record with the full payload it stands for, revisits too.

    Fails on a record whose payload is missing, or whose bytes do not give the digest that they are stored under.
    """
    headers = spark.read.schema("head string, block_head string, digest string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = payloads.select(
        "digest",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
        .alias("payload"),
    )
    joined = headers.join(checked, "digest", "left")
    missing = F.raise_error(F.concat(F.lit("missing payload "), F.col("digest"))).cast("binary")
    return joined.select("head", "block_head", "digest", F.coalesce("payload", missing).alias("payload"))


def header(name: str) -> Column:
    """The value of a line of ``head``, or null."""
    found = F.regexp_extract("head", rf"(?m)^{name}: ?([^\r\n]*)", 1)
    return F.when(found != "", found)


def records(archive: DataFrame) -> DataFrame:
    """``(page_id, uri, payload_bytes, payload_digest, record_type, refers_to, payload)`` as read from the archive.

    The digest is computed from the payload again; a record whose header says another one is an error.
    """
    def page(name: str) -> Column:
        value = F.regexp_extract(header(name), rf"^<{ID_PREFIX}(-?\d*)>$", 1)
        return F.when(value != "", value).cast("bigint")

    digest = base32_sha1(F.col("payload"))
    differs = F.raise_error(F.concat(F.lit("digest differs in "), F.col("head"))).cast("string")
    return archive.select(
        page("WARC-Record-ID").alias("page_id"),
        header("WARC-Target-URI").alias("uri"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(header("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest), digest).otherwise(differs).alias("payload_digest"),
        header("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        "payload",
    )


def export_warc(archive: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write whole records as WARC files. A revisit has no payload; every record ends with two line breaks."""
    body = F.when(header("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("head").cast("binary"), F.col("block_head").cast("binary"), body, F.lit(CRLF.encode()))
    # The text sink writes the bytes as they are and adds the second line break.
    archive.select(record.cast("string").alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)
