"""Content-addressed WARC archive (operator 11).

An archive is a folder of two tables. ``payloads`` holds every distinct payload once under its SHA-256.
``records`` holds the exact header bytes of every record (the WARC header and the HTTP header, each with the
empty line that ends it) and the address of its payload. Joins by address rebuild the records byte by byte,
as they stand in a .warc file, and give a revisit the payload of the record that it refers to.

Addresses are verified: records of one address must agree in SHA-1 and length when the archive is written,
and each stored payload is hashed again when it is read; a difference ends the job. Equal payloads are
combined before the shuffle, so that a payload which a third of all records share travels once per task; the
join that brings it back is one whose large groups Spark splits on the side of the small header rows.

Of records with equal payloads of LEAST_SHARED bytes or more, the one with the largest page_id is the
response and the others are revisits of it; smaller payloads give responses only.

Cases: a null html is an empty payload; a null url gives an empty target, and line breaks in urls are
percent-encoded in headers; a null page_id is never the one referred to unless no other is left, in which
case all are responses; rows that repeat a page_id with the same payload are all responses if it is the
largest, else all revisits; payloads of any length are hashed and stored whole; an empty table gives an empty
archive; other columns are not kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir, table

LEAST_SHARED = 1000

#: The record format, the profile of revisits and the ends of lines.
VERSION, PROFILE, LINE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "\r\n"

#: The pages carry no time; this one stands in their records unless another is given.
DATE = "2000-01-01T00:00:00Z"


def _joined(lines: list[Column | str]) -> Column:
    return F.concat(*[x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit(LINE))])


def _record_id(page: str, address: str) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.substring(F.lower(F.hex(address)), 1, 16), F.lit(">"))


def headers(known: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, address, header) from known's page_id, url, address, sha1, size and owner, the page that
    a revisit refers to (else null)."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("owner").isNotNull()
    http = _joined(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), ""])
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    first = [VERSION, F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), _record_id("page_id", "address")), F.concat(F.lit("WARC-Target-URI: "), url), f"WARC-Date: {date}", F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"))]
    more = F.when(revisit, _joined([f"WARC-Profile: {PROFILE}", F.concat(F.lit("WARC-Refers-To: "), _record_id("owner", "address"))])).otherwise("")
    last = ["Content-Type: application/http; msgtype=response", F.concat(F.lit("Content-Length: "), block.cast("string")), ""]
    return known.select("page_id", "address", F.encode(F.concat(_joined(first), more, _joined(last), http), "UTF-8").alias("header"))


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Writes the archive of pages (page_id, url, html) into a new folder."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("address", F.unhex(F.sha2("payload", 256)))
    rows.select("address", "payload").dropDuplicates(["address"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    known = rows.select("page_id", "url", "address", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    told = F.struct("sha1", "size")
    groups = known.groupBy("address").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"), F.min(told).alias("low"), F.max(told).alias("high")).where("n > 1")
    same = F.when(F.col("low") == F.col("high"), F.col("owner")).otherwise(F.raise_error(F.lit("two payloads have one address")).cast("long"))
    shared = groups.where(F.col("high.size") >= LEAST_SHARED).select("address", same.alias("owner"))
    owned = known.join(shared, "address", "left")
    is_owner = F.col("page_id").eqNullSafe(F.col("owner"))
    headers(owned.withColumn("owner", F.when(~is_owner, F.col("owner"))), date).write.option("compression", "zstd").parquet(f"{path}/records")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("address binary, payload binary").parquet(f"{path}/payloads")
    right = F.unhex(F.sha2("payload", 256)) == F.col("address")
    return rows.select("address", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary")).alias("payload"))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, address binary, header binary").parquet(f"{path}/records")


def field(header: Column, name: str) -> Column:
    """A field of a WARC header, null if it has none."""
    found = F.regexp_extract(header, rf"(?md)^{name}: ?([^\r\n]*)\r?$", 1)
    return F.when(header.rlike(rf"(?md)^{name}:"), found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, url, record_type, refers_to, digest, payload, record): fields as the header bytes
    tell them, the full payload also of revisits, and the record's bytes as in a .warc file."""
    rows = _headers(spark, path).drop("page_id").join(_payloads(spark, path), "address")
    head = F.split(F.decode("header", "UTF-8"), "\r\n\r\n", 2)[0]
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    kind = field(head, "WARC-Type")
    record_id, refers = field(head, "WARC-Record-ID"), field(head, "WARC-Refers-To")
    end = F.encode(F.lit(2 * LINE), "UTF-8")
    record = F.concat("header", F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload")), end)
    digest = F.regexp_replace(field(head, "WARC-Payload-Digest"), "^sha1:", "")
    return rows.select(record_id.alias("record_id"), number(record_id).alias("page_id"), field(head, "WARC-Target-URI").alias("url"), kind.alias("record_type"), number(refers).alias("refers_to"), digest.alias("digest"), "payload", record.alias("record"))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/coterie-warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_records(spark, path).withColumn("found", F.sha1("payload"))
    right = F.when(F.col("found") == F.col("digest"), F.col("found")).otherwise(F.raise_error(F.lit("a payload does not have the digest of its record")))
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), right.alias("payload_digest"), "record_type", "refers_to")


OP11_ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
  g AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY sha256(payload)) AS owner FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 1000 OR page_id = owner THEN NULL ELSE owner END AS refers_to FROM g
"""
