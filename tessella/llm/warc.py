"""WARC archives with revisit resolution by payload digest.

Only headers are compared: records are grouped by payload digest, the original
of each group stays a response and the others become revisits of it.  Archives
are written by Spark's text writer (a record ends in CRLF CRLF, which is the
writer's line separator), gzip-compressed, and read back by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, lookup_join, materialize, scratch_path, trimmed

#: Smaller payloads are stored whole wherever they occur.
LEAST_BYTES = 1_000
#: Records of one archive file at most, and about its bytes at most: it is read back by one task.
FILE_RECORDS, FILE_BYTES = 1_000, 256 << 20
CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column, digest: Column) -> Column:
    """A UUID derived from the row, the same whenever it is written."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def originals(headers: DataFrame) -> DataFrame:
    """(payload_digest, original, n): of digests that occur more than once, the largest page_id."""
    big = headers.filter(F.col("payload_bytes") >= LEAST_BYTES)
    return big.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of page_id, url, html below ``path``, as gzip files.

    Of equal payloads of at least LEAST_BYTES, the one with the largest page_id is
    a response and the others are revisits that refer to it; repeated rows of that
    page_id are responses too.  A null html is an empty payload; a null url gives
    no target URI; line ends in urls are dropped; a null page_id is never an
    original where a group has others, and is stored with an empty page field.
    """
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("bigint")).withColumn("payload_digest", F.sha1("html"))
    headers = materialize(rows.select("page_id", "payload_bytes", "payload_digest"), "warc-seen")
    known = materialize(originals(headers), "warc-originals")
    longest = headers.agg(F.max("payload_bytes")).first()[0] or 0
    total = known.agg(F.sum("n")).first()[0] or 0
    # smaller payloads are responses wherever they occur: they have no key to meet by
    rows = rows.withColumn("_key", F.when(F.col("payload_bytes") >= LEAST_BYTES, F.col("payload_digest")))
    rows = lookup_join(rows, known.withColumnRenamed("payload_digest", "_key"), "_key", "n", total)
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    refers = F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("original"), F.col("payload_digest"))), line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Truncated", F.lit("length")))).otherwise("")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url") != "", line("WARC-Target-URI", F.col("url"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        refers,
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    # records of like size share files, as many as FILE_BYTES holds of the largest
    least, most = -1, FILE_BYTES // FILE_RECORDS
    while least < longest:
        some = rows.filter((F.col("payload_bytes") > least) & (F.col("payload_bytes") <= most)).select(F.concat(header, block).alias("value"))
        records = max(1, min(FILE_RECORDS, FILE_BYTES // most))
        some.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        least, most = most, most * 32
    discard(headers, known)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive, plain or gzip."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8").split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        body = end + 4 + int(fields["content-length"])
        yield fields, data[end + 4 : body]
        at = body + 4


def hex_digest(value: str) -> str:
    """The bare hexadecimal digest of ``sha1:`` and base 32 or hexadecimal digits."""
    digits = value.rpartition(":")[2]
    return base64.b32decode(digits).hex() if len(digits) == 32 else digits.lower()


_READ = "page_id long, record_type string, record_id string, refers_to_id string, payload_digest string, stored_bytes long, url string"
_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)")


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives below ``path``; ``payloads`` adds each stored payload (null for revisits).

    The digest of a stored payload is computed afresh and must be the one in its header.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = [[] for _ in range(8)]
                for f, block in parse_archive(content.as_py()):
                    kind, digest = f["warc-type"], hex_digest(f["warc-payload-digest"])
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} does not have its digest")
                    page = f.get("x-page-id", "")
                    row = (int(page) if page else None, kind, f["warc-record-id"], f.get("warc-refers-to"), digest, len(payload) if payload is not None else None, f.get("warc-target-uri"), payload)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = ["page_id", "record_type", "record_id", "refers_to_id", "payload_digest", "stored_bytes", "url", "payload"]
                n = 8 if payloads else 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds, strict=False)], names[:n])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(trimmed(run, 1), _READ + ", payload binary" * payloads)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Join revisits to the responses they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit whose response is not among ``headers`` keeps a null size and null refers_to.
    ``headers`` must be a written table.
    """
    revisits = headers.filter("record_type = 'revisit'").groupBy(F.col("refers_to_id").alias("_id")).agg(F.count("*").alias("n"))
    needed = materialize(revisits, "warc-needed")
    found = headers.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"), F.col("stored_bytes").alias("original_bytes"))
    table = materialize(needed.join(found, "_id").dropDuplicates(["_id"]).select(F.col("_id").alias("refers_to_id"), "refers_to", "original_bytes", "n"), "warc-referred")
    total = table.agg(F.sum("n")).first()[0] or 0
    rows = lookup_join(headers, table, "refers_to_id", "n", total)
    return rows.select("page_id", F.coalesce("stored_bytes", "original_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared scratch folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return resolve_revisits(materialize(read_archives(spark, path), "warc-headers"))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM o
"""
