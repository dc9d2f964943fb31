"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds the bytes of each distinct payload once, under its
SHA-256; ``headers`` holds the exact WARC and HTTP header bytes of each record, with the digest of its
payload. A record is header bytes followed, for a response, by the payload; joining the tables on the
digest gives each record back. Every payload read is hashed again and must agree with its address.

Defined cases: a null payload is empty; a null url is an empty header value; CR and LF in a url are
percent-encoded; the record of a null page id is numbered ``null`` and is never the one others refer to
unless all ids of its payload are null; repeated rows give repeated records; an empty table gives an
empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits at a time become four characters."""
    digits = F.sha1(payload)
    out = []
    for i in range(8):
        v = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """Writes ``path/payloads`` and ``path/headers``. Of equal payloads of at least min_bytes the record
    with the smallest id is a response and the others revisit it; smaller payloads are all responses."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    # copies merge before the shuffle; payloads of one digest that differ in length or SHA-1 are no copies
    other = F.concat(F.octet_length("payload").cast("string"), F.lit(":"), F.sha1("payload"))
    ends = rows.withColumn("other", other).groupBy("digest").agg(F.max("payload").alias("payload"), F.min("other").alias("low"), F.max("other").alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest"))).cast("binary"))
    ends.select("digest", one.alias("payload")).write.parquet(f"{path}/payloads")

    small = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"), sha1_base32(F.col("payload")).alias("b32")).join(first, "digest")
    revisit = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    refers = F.concat(F.lit("WARC-Refers-To: "), urn("first_id"), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("b32"), F.lit("\r\n"), F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))).cast("string"), F.lit("\r\n\r\n"), http,
    )
    small.select("digest", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, header_digest (all from the header bytes),
    payload_bytes and payload_digest (from the payload, read and verified), record (the whole record).

    Digest and length are taken once per stored payload, before the join; a reader that asks for no
    record moves no payload.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("long"))
    stored = stored.select("digest", "payload", sound.alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    heads = spark.read.parquet(f"{path}/headers").withColumn("head", F.col("header").cast("string"))
    field = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    number = lambda name: F.nullif(F.regexp_extract(field(name), "<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")
    kind = field("WARC-Type")
    joined = heads.join(stored, "digest")
    return joined.select(
        number("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), kind.alias("record_type"),
        F.when(kind == "revisit", number("WARC-Refers-To")).alias("refers_to"),
        F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("header_digest"), "payload_bytes", "payload_digest",
        F.concat("header", F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))).alias("record"),
    )


def export_records(archive: DataFrame, path: str) -> None:
    """Writes whole records as .warc text: each record, then CR LF CR LF. Payloads must be UTF-8."""
    archive.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
