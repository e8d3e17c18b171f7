"""Deduplicated WARC archives: equal payloads are stored once and revisited."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Payloads below this many bytes are stored each time.
LEAST_BYTES = 100
#: Payload bytes that a file should hold; a file is read in one piece.
FILE_BYTES = 1 << 25
#: Fixed values of the format.
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_key() -> Column:
    """What tells records apart that may differ in their type: page_id and payload."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(page, F.lit(":"), F.col("payload_digest"))


def revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``record_key, refers_to`` of the records that revisit another one.

    ``headers`` has ``page_id, payload_digest, payload_bytes``; payloads play no part. Of the rows
    with an equal digest and at least ``least`` bytes, the one with the smallest page_id is the
    response and the others revisit it; rows that share this smallest page_id are all responses.
    A null page_id comes after all others: it revisits, unless every one of its group is null.
    """
    large = headers.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    firsts = (
        large.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n"))
        .filter("_n > 1 and refers_to is not null")
        .drop("_n")
    )
    # Copies with one page_id are one row here, so that they do not multiply what they find.
    found = large.distinct().join(firsts, "payload_digest")
    found = found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select(record_key().alias("record_key"), "refers_to")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def _escaped(url: Column) -> Column:
    """A URI for a header line: no control characters or spaces, null becomes empty."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def record_text() -> Column:
    """A whole record, without the blank lines after it: headers, a blank line and the payload.

    The record id is made of the page_id and the digest. A revisit has no payload and names the
    record that has it, through its digest, its page id and its target.
    """
    revisit = F.col("record_type") == "revisit"
    stored_bytes = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.col("payload_digest"), F.lit(">"))),
        _line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", _escaped(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("X-Page-ID", page),
        _line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", _PROFILE),
                _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("payload_digest"), F.lit(">"))),
            ),
        ).otherwise(F.lit("")),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", stored_bytes.cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``page_id, url, html`` as WARC files, one record per row (null html: empty).

    Headers are shuffled by digest to find the revisits, and these come back by record key. The
    shuffle that brings them to the payloads is also the one that deals the records to files,
    so each payload moves once. Files are WARC 1.1, compressed by gzip as a whole: Spark's text
    writer ends each record with two line breaks, as the format asks. Repeated rows give a
    record each.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    records = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {
            "payload_digest": F.sha2(F.col("payload").cast("binary"), 256),
            "payload_bytes": F.octet_length("payload").cast("bigint"),
        }
    )
    headers = stored(records.select("page_id", "payload_digest", "payload_bytes"), "headers")
    total = headers.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(total // FILE_BYTES + 1, spark.sparkContext.defaultParallelism)
    found = stored(revisits(headers), "revisits").repartition(files, "record_key")
    dealt = records.withColumn("record_key", record_key()).repartition(files, "record_key")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    resolved = dealt.join(found, "record_key", "left").withColumn("record_type", kind)
    text = resolved.select(record_text().alias("value"))
    text.write.option("lineSep", _END).option("compression", "gzip").text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not re.fullmatch(r"WARC/\d\.\d", lines[0]):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = end + 4
        at = begin + int(headers["content-length"])
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record ends wrong at byte {at}")
        yield headers, content[begin:at]
        at += 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Every record of the archives, as written in them; a response's digest is checked against
    its payload. A revisit has no payload of its own (null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for headers, block in parse(gzip.decompress(content.as_py())):
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"{headers['warc-record-id']}: wrong digest")
                    refers = headers.get("warc-refers-to", "").removeprefix("<urn:page:")
                    rows.append(
                        {
                            "page_id": int(headers["x-page-id"]) if headers["x-page-id"] else None,
                            "url": headers["warc-target-uri"],
                            "payload_bytes": int(headers["x-payload-bytes"]),
                            "payload_digest": digest,
                            "record_type": headers["warc-type"],
                            "refers_to": int(refers.partition(":")[0]) if revisit else None,
                            "payload": None if revisit else block.decode(),
                        }
                    )
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        run,
        "page_id bigint, url string, payload_bytes bigint, payload_digest string,"
        " record_type string, refers_to bigint, payload string",
    )


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.string()),
    ]
)
