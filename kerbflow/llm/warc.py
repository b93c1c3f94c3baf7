"""Content-addressed web archive.

Payload bytes are stored once in ``payloads`` under their SHA-256; every record keeps its own exact header
bytes in ``records``; original records come back by a join on the digest. Among rows with equal payloads the
one with the largest page id (then URL, then copy number) is the response, the others are revisits of it.

Defined cases: a null html is the empty payload, which is archived like any other; a null URL leaves out the
target line, line breaks in URLs are percent-encoded; a null page id gives a record with an empty id;
repeated rows give one record each; an empty table gives two empty tables; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.session import materialise

# Fixed values of the formats: base 32 alphabet, WARC 1.1 revisit profile.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA_RECORDS = "page_id long, copy int, sha256 string, header binary, http binary"
SCHEMA_PAYLOADS = "sha256 string, payload binary"


def base32(hexadecimal: Column, digits: int = 40) -> Column:
    """Base 32 text of hex digits; five hex digits are twenty bits, so four letters."""
    letters = []
    for first in range(1, digits, 5):
        bits = F.conv(F.substring(hexadecimal, first, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a line whose value is null is left out."""
    parts = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in pairs]
    return F.concat(*parts, F.lit("\r\n"))


def _record_id(page_id: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), copy.cast("string"), F.lit(">"))


def fingerprints(pages: DataFrame) -> DataFrame:
    """One row per page: id, URL, payload length and digests; the payload itself is dropped in the scan's stage."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"))


def write_archive(pages: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``root/records`` and ``root/payloads`` for pages (page_id, url, html).

    Equal SHA-256 with a different length or SHA-1 stops the job: a digest is never trusted alone.
    """
    light = materialise(fingerprints(pages).groupBy("page_id", "url", "bytes", "sha256", "sha1").agg(F.count(F.lit(1)).cast("int").alias("copies")), "warc-pages")
    light = light.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    order = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("rank"), F.coalesce("url", F.lit("")).alias("address"), F.col("copy"), F.col("page_id"), F.col("url"))
    chosen = light.groupBy("sha256").agg(F.max(order).alias("top"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.min("sha1").alias("low"), F.max("sha1").alias("high"))
    same = (F.col("least") == F.col("most")) & (F.col("low") == F.col("high"))
    chosen = materialise(chosen.select("sha256", F.when(same, F.col("top")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("top")), "warc-responses")

    records = light.join(chosen, "sha256")
    response = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")) & (F.col("copy") == F.col("top.copy"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    header = F.concat(F.lit("WARC/1.1\r\n"), _lines(
        ("WARC-Type", F.when(response, "response").otherwise("revisit")),
        ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("copy"))),
        ("WARC-Target-URI", target),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        ("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(~response, _record_id(F.col("top.page_id"), F.col("top.copy")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.length(http) + F.when(response, F.col("bytes")).otherwise(0)).cast("string"))))
    records.select("page_id", "copy", "sha256", header.cast("binary").alias("header"), http.cast("binary").alias("http")).write.parquet(f"{root}/records")

    # A page id meets few rows, so this join has no hot key whatever the payloads are.
    wanted = chosen.select("sha256", F.col("top.page_id").alias("page_id"), F.col("top.url").alias("url")).withColumn("key", F.xxhash64("page_id", "url"))
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("key", F.xxhash64("page_id", "url"))
    stored = keyed.join(wanted.withColumnsRenamed({"page_id": "p", "url": "u"}), "key")
    stored = stored.where(F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.sha2("payload", 256) == F.col("sha256")))
    repeated = light.where("copies > 1").limit(1).count() > 0
    stored = stored.select("sha256", "payload")
    (stored.dropDuplicates(["sha256"]) if repeated else stored).write.parquet(f"{root}/payloads")


def read_archive(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Headers and payloads of an archive."""
    return spark.read.schema(SCHEMA_RECORDS).parquet(f"{root}/records"), spark.read.schema(SCHEMA_PAYLOADS).parquet(f"{root}/payloads")


def verified(payloads: DataFrame) -> DataFrame:
    """Length and digests recomputed from the stored bytes; bytes that do not match their address stop the job."""
    good = F.sha2("payload", 256) == F.col("sha256")
    address = F.when(good, F.col("sha256")).otherwise(F.raise_error(F.lit("payload does not match its address")))
    return payloads.select(address.alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))


def field(name: str) -> Column:
    """Value of a header line, null where there is none."""
    value = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.length(value) > 0, value)


def record_index(spark: SparkSession, root: str) -> DataFrame:
    """One row per record, parsed from the headers and checked against the stored payloads."""
    records, payloads = read_archive(spark, root)
    parsed = records.select("sha256", field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("told"),
                            F.regexp_extract(field("WARC-Record-ID"), r"^<urn:page:(-?\d*):\d+>$", 1).alias("own"),
                            F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?\d*):\d+>$", 1).alias("other"))
    joined = parsed.join(verified(payloads), "sha256", "left")
    digest = F.when(F.col("told") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record has no matching payload")))
    number = lambda name: F.expr(f"try_cast(nullif({name}, '') AS long)")
    return joined.select(number("own").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number("other").alias("refers_to"))


def original_records(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, copy, record) with the full bytes of each record; revisits get the payload they stand for as ``payload``."""
    records, payloads = read_archive(spark, root)
    joined = records.join(payloads, "sha256", "left")
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", "copy", F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"), "payload")
