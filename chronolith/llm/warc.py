"""Deduplicated WARC archives: revisit resolution by payload digest.

Headers (no payloads) are shuffled by payload digest to find the first record of each payload that occurs again; later
records of the same payload become revisit records that refer to it. Pages are joined to the table of such digests, by
Spark's own size check without moving a payload if that table is small. Archives are written anew with fresh headers by
Spark's own writer (one gzip stream a file, files of about FILE_BYTES of records), so that lost executors cost nothing
but a repeated task, and read back record by record.

Defined cases: a null payload is empty; a null url gives a record without WARC-Target-URI; ids may be numbers or strings
of any characters; records with equal payloads and the same smallest id are all responses, and repeated rows have equal
record ids; a record without id is a revisit if its payload has a record with an id, and a response otherwise; an empty
table gives an empty result; further columns are ignored. A record must fit in memory.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import map_arrow, new_path, stored, table

MIN_PAYLOAD = 100  # bytes from which equal payloads are written once
FILE_BYTES = 64 << 20  # of an archive's records, on average
NAMELESS = "urn:record"  # a record without an id; others have it, encoded, after a colon
END = "\r\n\r\n"


def headers(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """record_id, payload_digest and payload_bytes of every page."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(F.col(id_col).alias("record_id"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def resolve(heads: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """digest and first: of payloads that several records have, the smallest record id.

    Partial aggregation shrinks hot digests before the shuffle, and one row a digest comes back.
    """
    first = heads.where(F.col("payload_bytes") >= min_payload).groupBy(F.unhex("payload_digest").alias("digest")).agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
    return stored(first.where("n > 1 and first is not null").select("digest", "first"), "digests", few=True)


def _clean(col):
    """A header value: control characters and blanks as percent codes."""
    for code in (10, 13, 32, 9):
        col = F.replace(col, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return col


def records(pages: DataFrame, again: DataFrame, id_col: str, payload_col: str, url_col: str, date: str | None) -> DataFrame:
    """One row `record` per page: the text of its WARC record, without the end-of-record mark."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    own = pages.select(F.col(id_col).alias("record_id"), payload.alias("payload"), F.col(url_col).alias("url")).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    both = own.join(again, F.unhex("payload_digest") == F.col("digest"), "left").withColumn("refers_to", F.when(~F.col("record_id").eqNullSafe(F.col("first")), F.col("first")))
    revisit = F.col("refers_to").isNotNull()
    named = lambda c: F.concat(F.lit(f"<{NAMELESS}"), F.coalesce(F.concat(F.lit(":"), F.url_encode(c.cast("string"))), F.lit("")), F.lit(">"))
    when = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else F.lit(date)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), named(F.col("record_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), named(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return both.select(F.concat(head, F.lit(END), block).alias("record"))


def write(rows: DataFrame, path: str, per_file: int) -> None:
    """Write records as gzip archives. Records end with two line ends, which the text writer puts after each row."""
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or stream.read(4) != END.encode():
            raise ValueError("a record is cut short")
        yield head, block


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives under path: record_id (of id_type), record_type, payload_bytes and payload_digest (of the
    payload itself for responses, as declared for revisits, whose payload_bytes is null), refers_to, url."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                for head, block in parse(gzip.open(io.BytesIO(content.as_py()))):
                    own, other = (unquote_plus(x[len(NAMELESS) + 1 :]) if (x := head.get(k, "").strip("<>")).startswith(f"{NAMELESS}:") else None for k in ("warc-record-id", "warc-refers-to"))
                    declared = head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "response":
                        payload = block.partition(END.encode())[2]
                        out.append((own, "response", len(payload), hashlib.sha256(payload).hexdigest(), None, head.get("warc-target-uri")))
                    else:
                        out.append((own, "revisit", None, declared, other, head.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * 6, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = map_arrow(files, parsed, "record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, url string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("record_id", "refers_to")})


def with_originals(rows: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Join revisit records to the responses they refer to, for the size of their payload."""
    response = rows.where("record_type = 'response'")
    revisit = rows.where("record_type = 'revisit'").drop("payload_bytes")
    target = stored(
        response.where(F.col("payload_bytes") >= min_payload).join(revisit.select(F.col("payload_digest")).distinct(), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes")),
        "originals",
    )
    return response.unionByName(revisit.join(target, "payload_digest", "left"))


def deduplicated_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_payload: int = MIN_PAYLOAD, date: str | None = None, file_bytes: int = FILE_BYTES
) -> None:
    """Write pages as deduplicated archives under path. date: of all records; None: the time of writing."""
    heads = headers(pages, id_col, payload_col)
    mean = heads.agg(F.avg("payload_bytes")).first()[0] or 0
    per_file = max(1, int(file_bytes / (mean + 600)))  # headers take about 600 bytes
    write(records(pages, resolve(heads, min_payload), id_col, payload_col, url_col, date), path, per_file)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    deduplicated_archive(table(spark, sf_dir, "pages"), path)
    found = with_originals(stored(read(spark, path), "records"))
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
