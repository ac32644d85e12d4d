"""WARC archives: deduplicated writing, reading, and revisit resolution by payload digest."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waygrid.session import shared_dir

MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                    ("refers_to", pa.int64()), ("payload", pa.binary()), ("own_bytes", pa.int64()), ("intact", pa.bool_())])
DDL = ("page_id bigint, target_uri string, record_type string, payload_digest string, refers_to bigint, payload binary, "
       "own_bytes bigint, intact boolean")


def resolve(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add record_type and refers_to to rows with page_id, payload_digest and payload_bytes.

    Digests are counted first (one row a digest leaves each task); rows then meet only the originals
    of digests that occur twice, in a join that adaptive execution can split when one digest holds most
    rows. Smaller payloads are never revisits. Rows that repeat the largest page_id are all responses;
    a null page_id is the response only if no other row has the digest.
    """
    originals = (headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                 .agg(F.max("page_id").alias("_original"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    revisit = F.col("_original").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_original"))
    return (headers.join(originals, "payload_digest", "left")
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("_original"))).drop("_original"))


def _record(date: str):
    """One WARC record as text, without the closing blank lines."""
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("_html")))
    field = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    one_line = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")
    return F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", ident(F.col("page_id"))),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", F.when(one_line != "", one_line)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("WARC-Refers-To", F.when(revisit, ident(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"),
        F.lit("\r\n\r\n"), http)


def write_archives(pages: DataFrame, path: str, date: str = DATE, min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write a record per row of (page_id, url, html) to gzip files of at most ``RECORDS_PER_FILE`` records.

    A null html is an empty payload. Line breaks inside a url become blanks. Equal payloads of
    ``min_bytes`` or more are stored once (see ``resolve``).
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("_html").cast("long"), "payload_digest": F.sha1(F.encode("_html", "UTF-8"))})
    (resolve(rows, min_bytes).select(_record(date).alias("value")).write.mode("error").option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path))
    return path


def records_of(data: bytes) -> Iterator[tuple]:
    """Records of one archive (plain or gzip, any number of members): page_id, uri, type, digest, refers_to, payload."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            inflate = zlib.decompressobj(31)
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
        data = b"".join(parts)
    page = lambda v: int(v[10:-1]) if v and v != b"<urn:page:none>" else None
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
        size = int(head[b"Content-Length"])
        block = data[end + 4:end + 4 + size]
        at = end + 4 + size + 4
        yield (page(head[b"WARC-Record-ID"]), head.get(b"WARC-Target-URI", b"").decode() or None, head[b"WARC-Type"].decode(),
               head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), page(head.get(b"WARC-Refers-To")), block.partition(b"\r\n\r\n")[2])


def _parse(payloads: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for *head, payload in records_of(content.as_py()):
                    intact = hashlib.sha1(payload).hexdigest() == head[3] if head[2] == "response" else None
                    rows.append((*head, payload if payloads else None, len(payload), intact))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)
    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of every archive below ``path``; a file, bounded when written, is held by one task at a time.

    ``own_bytes`` is the size of the payload in the record, ``intact`` whether a response's payload has the digest of its
    header. Without ``payloads`` only the headers leave the task. A folder without records gives no rows.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse(payloads), DDL)


def _originals(records: DataFrame, *facts) -> DataFrame:
    """One response for each (page, digest) that a revisit refers to."""
    asked = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("_page"), F.col("payload_digest").alias("_digest")).distinct()
    return (records.where("record_type = 'response'")
            .join(asked, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left_semi")
            .groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(*facts))


def _to_originals(records: DataFrame, originals: DataFrame) -> DataFrame:
    return records.join(originals, F.col("refers_to").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
                        & (F.col("record_type") == "revisit"), "left").drop("_page", "_digest")


def with_originals(records: DataFrame) -> DataFrame:
    """Add payload_bytes of the full payload; a revisit takes it from the response that it refers to. Records are read three
    times: hand over written ones, or headers that have been written.
    """
    sizes = _originals(records, F.max("own_bytes").alias("_full"))
    return _to_originals(records, sizes).withColumn("payload_bytes", F.coalesce("_full", "own_bytes")).drop("_full")


def with_payloads(records: DataFrame) -> DataFrame:
    """Records in which revisits carry the payload of the response that they refer to."""
    bodies = _originals(records, F.first("payload").alias("_body"))
    return _to_originals(records, bodies).withColumn("payload", F.coalesce("_body", "payload")).drop("_body")


def new_archive_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
