"""WARC archives with revisits resolved.

Records are text, so Spark's own writer and reader move them: a record is one
row ended by an empty line, and reading takes whole files (``binaryFile``),
unpacks them as a stream and cuts them by Content-Length, so a task holds one packed
file and one record.  Nothing opens a path in Python, so any store that Spark reaches will do.  Payloads
are written where they are read: they are not shuffled.  Records are written by
classes of size, so a file has about ``FILE_BYTES`` of payloads at most, or one record.

:func:`write_archive` writes a ``warcinfo`` record and a response record per page.  :func:`deduplicate`
reads archives, shuffles the headers (never payloads) by payload digest, picks
the record with the smallest page id of each digest as the original and writes
new archives with fresh headers, where all others are revisit records without a
payload.  :func:`resolved` joins revisits back to their originals.  Payloads are hashed when
they are read, so a damaged record counts as what is in it, is marked, and is no copy of others.

Defined cases: a null payload is empty; a null url becomes ``about:blank``;
line breaks in a url are percent-encoded; payloads below ``LEAST`` bytes are all
responses; rows with one page id and payload are told apart by their record id,
the first one is the response and the others revisit it; pages without an id come
after all others; an empty table gives no records but the ``warcinfo``; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lookup, scratch_dir, ship_package, stored

#: Payloads below this many bytes are never revisits.
LEAST = 100
#: Bytes of a file's payloads, about: a file is read by one task.
FILE_BYTES = 64 << 20
#: Largest payloads of the classes that records are written in; beyond the last a record has a file.
CLASSES = (16 << 10, 512 << 10, 8 << 20)
END = "\r\n\r\n"
#: Bytes of an unpacked archive that are read at a time.
READ = 1 << 18

HEADERS = "page_id long, record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_record string, damaged boolean"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record(kind: Column, payload: Column, date: str) -> Column:
    """The text of a record; ``payload`` is left out of revisits."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(kind == "response", payload).otherwise(""))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "\r", "%0D"), "\n", "%0A")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("page_id").isNotNull(), _line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("refers_record"), F.lit(">")))).otherwise(""),
        F.when(revisit & F.col("refers_to").isNotNull(), _line("X-Refers-To-Page", F.col("refers_to").cast("string"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(http).cast("string")),
        F.lit("\r\n"),
        http,
    ]
    return F.concat(*lines)


def _write(records: DataFrame, path: str, headers: DataFrame | None = None) -> None:
    """Records to files below ``path``, by the classes of size that occur (in ``headers``, if those are there)."""
    spark, date = records.sparkSession, _now()
    fields = "software: parlance\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}",
        "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}", "", fields,
    ]
    info = spark.createDataFrame([("\r\n".join(head),)], "value string").coalesce(1)
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    place = F.lit(0)
    for bound in CLASSES:
        place = place + (size > bound).cast("int")
    found = {r[0] for r in (records if headers is None else headers).select(place.alias("k")).distinct().collect()}
    for k in sorted({*found, 0}):
        some = records.filter(place == k) if len(found) > 1 else records
        lines = some.select(_record(F.col("record_type"), F.col("payload"), date).alias("value"))
        most = max(1, FILE_BYTES // CLASSES[k]) if k < len(CLASSES) else 1
        writer = (lines.unionAll(info) if k == 0 else lines).write.mode("append").option("lineSep", END)
        writer.option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def write_archive(pages: DataFrame, path: str) -> None:
    """A response record for each row of ``page_id, url, html``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.uuid().alias("record_id"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_record"),
    )
    _write(records, path)


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an unpacked archive, read ``READ`` bytes at a time."""
    held, at = b"", 0
    while True:
        start = held.find(b"WARC/1.", at)
        stop = held.find(b"\r\n\r\n", start) if start >= 0 else -1
        if stop < 0:
            at = start if start >= 0 else max(at, len(held) - 6)
            more = stream.read(READ)
            if not more:
                return
            held, at = held[at:] + more, 0
            continue
        lines = held[start:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines if ": " in line)
        first, end = stop + 4, stop + 4 + int(headers["Content-Length"])
        if end > len(held):
            block = held[first:] + stream.read(end - len(held))
            held, at = b"", 0
        else:
            block, at = held[first:end], end
        yield headers, block


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Headers of all records, and payloads if asked for.

    Digest and length of a response are those of the payload that is there; ``damaged`` says
    that its header names others.  Those of a revisit, which has none, are its header's.
    """
    ship_package(spark)

    names = ["page_id", "record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "refers_record", "damaged"]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    if payloads:
        names, kinds = [*names, "payload"], [*kinds, pa.string()]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                packed = pa.BufferReader(content.as_buffer())
                stream = gzip.GzipFile(fileobj=packed) if name.endswith(".gz") else packed
                found: list[tuple] = []
                held = 0
                for h, block in parse_records(stream):
                    if h["WARC-Type"] not in ("response", "revisit"):
                        continue
                    number = lambda key: int(h[key]) if key in h else None
                    urn = lambda key: re.sub(r"^<urn:uuid:|>$", "", h[key]) if key in h else None
                    named = digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), number("X-Payload-Length")
                    payload = block[block.find(b"\r\n\r\n") + 4 :]
                    if h["WARC-Type"] == "response":
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    row = (
                        number("X-Page-ID"), urn("WARC-Record-ID"), h.get("WARC-Target-URI"), h["WARC-Type"],
                        digest, size, number("X-Refers-To-Page"), urn("WARC-Refers-To"), named != (digest, size),
                    )
                    if payloads:
                        row += (payload.decode("utf-8", "replace"),)
                        held += len(block)
                    found.append(row)
                    if len(found) >= 500 or held > 8 << 20:
                        yield batch_of(found)
                        found, held = [], 0
                if found:
                    yield batch_of(found)

    schema = HEADERS + (", payload string" if payloads else "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > 0).select("path", "content").mapInArrow(rows, schema)


def revisits(headers: DataFrame) -> DataFrame:
    """Headers with type and original, resolved by payload digest.

    Originals are found by a sum over each digest, combined before the shuffle, and
    looked up with hot digests apart, so a digest that a third of the records share is
    no single task.
    """
    named = headers.select("page_id", "record_id", "payload_digest", "payload_bytes")
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")
    originals = named.filter(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(
        F.min(rank).alias("first"), F.count(F.lit(1)).alias("records")
    ).filter("records > 1").select("payload_digest", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record"))
    again = (F.col("payload_bytes") >= LEAST) & F.col("first_record").isNotNull() & (F.col("first_record") != F.col("record_id"))
    return lookup(named, stored(originals, "originals"), "payload_digest").select(
        "record_id",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_page")).alias("refers_to"),
        F.when(again, F.col("first_record")).alias("refers_record"),
    )


def deduplicate(spark: SparkSession, source: str, target: str) -> None:
    """Archives at ``source`` written to ``target`` with revisits in place of repeated payloads."""
    headers = stored(read_archive(spark, source), "warc-headers")
    decided = stored(revisits(headers).filter("record_type = 'revisit'"), "revisits")
    whole = read_archive(spark, source, payloads=True).drop("record_type", "refers_to", "refers_record", "damaged")
    records = lookup(whole, decided, "record_id").withColumn("record_type", F.coalesce("record_type", F.lit("response")))
    _write(records, target, headers)


def resolved(headers: DataFrame) -> DataFrame:
    """Revisits with the length and digest of the original response they name.

    A revisit whose original is not in the archive keeps what its own header says.
    """
    originals = headers.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_record"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("page_id").alias("p")
    )
    first = headers.filter("record_type = 'response'")
    named = headers.filter("record_type = 'revisit'").select("refers_record").distinct()
    originals = stored(originals.join(named, "refers_record", "left_semi"), "originals")
    again = lookup(headers.filter("record_type = 'revisit'"), originals, "refers_record").select(
        "page_id", F.coalesce("b", "payload_bytes").alias("payload_bytes"), F.coalesce("d", "payload_digest").alias("payload_digest"),
        "record_type", F.coalesce("p", "refers_to").alias("refers_to"),
    )
    return first.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)


def op6_revisit_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written, deduplicated, read back and resolved."""
    raw, deduplicated = scratch_dir(spark, "warc-raw"), scratch_dir(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), raw)
    deduplicate(spark, raw, deduplicated)
    return resolved(stored(read_archive(spark, deduplicated), "warc-headers"))
