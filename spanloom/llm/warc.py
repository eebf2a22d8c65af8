"""WARC archives: a writer that turns repeated payloads into revisits, and a salvage reader.

Writing: payload digests are counted first (a row for each payload, summed
before they are shuffled); of equal payloads the least page_id is the response and the
others refer to it. Records are then made and written by Spark's text writer,
whose line end is the two line ends that close a record, so that archives go to
any file system that Spark knows, in files of bounded size.

Reading: archives come as binary files, plain or compressed by members. A
record must have a version line, a length that ends at a record's end, and, where it holds its payload,
the right digest. Where a check fails, the reader searches for the next version line or
member that passes, goes on from there and logs the bytes between as a gap.

Defined cases: a null html is an empty payload. A null url leaves out the
target. A null page_id is left out of the id; null ids revisit a payload that a numbered page has, and are
responses otherwise, as are all rows that repeat the least id. An empty table gives archives without records.
A damaged or empty file gives gaps or nothing, never an error. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, shared_path, written

#: The date of records whose time of capture isn't known.
DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 8 << 20
#: Longest payloads of records that are written together, and the most records in a file of these: no file has over a GB. Longer ones have files of their own.
CLASSES = ((1 << 16, 1 << 14), (1 << 22, 1 << 8))
#: Repeated payloads up to which their digests (under 100 bytes each) are broadcast.
BROADCAST_ROWS = 100_000
_CRLF = "\r\n"


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a hex digest of a multiple of 5 digits: 5 hex digits are 4 of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(length: Column, first: Column) -> Column:
    """A record without the two line ends that close it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), length.cast("string"), F.lit(_CRLF * 2))
    revisit = first.isNotNull()
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{_CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">{_CRLF}WARC-Date: {DATE}{_CRLF}"),
        F.when(target.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), target, F.lit(_CRLF))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"), F.lit(_CRLF),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), first.cast("string"), F.lit(f">{_CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "),
    )
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(length)
    return F.concat(head, block.cast("string"), F.lit(_CRLF * 2), http, F.when(revisit, "").otherwise(F.col("_html")))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives of a record for each row of pages; equal payloads of at least least_bytes are kept once."""
    html = F.coalesce(column(pages, "html", "string"), F.lit(""))
    base = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), html.alias("_html"))
    base = base.withColumn("_digest", base32(F.sha1(F.col("_html").cast("binary"))))
    length = F.octet_length("_html").cast("long")
    facts = written(base.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"), F.max(length).alias("_bytes")), "payloads")
    totals = facts.agg(F.sum(F.col("_n") * (F.col("_bytes") + 600)).alias("bytes"), F.sum("_n").alias("n"), F.max("_bytes").alias("longest")).first()
    firsts = facts.filter((F.col("_n") > 1) & F.col("_first").isNotNull() & (F.col("_bytes") >= least_bytes)).select("_digest", "_first")
    # Few repeated payloads go to all tasks, so that pages stay where they are; many are joined by a shuffle.
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = base.join(F.broadcast(firsts) if few else firsts, "_digest", "left")
    first = F.when(F.col("page_id").eqNullSafe(F.col("_first")), F.lit(None)).otherwise(F.col("_first"))
    rows = max(1, int(FILE_BYTES * (totals["n"] or 1) / (totals["bytes"] or 1)))
    least = -1
    for most, records in (*CLASSES, (None, 1)):
        if least < 0 or (totals["longest"] or 0) > least:
            own = held.filter((length > least) if most is None else (length > least) & (length <= most))
            own.select(_record(length, first).alias("value")).write.mode("append").option("lineSep", _CRLF * 2).option("maxRecordsPerFile", min(rows, records)).text(path)
        least = most


STEP = 1 << 16
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out.setdefault(name, value.strip())
    return out


def _body(block: bytes, fields: dict[str, str]) -> tuple[dict[str, str], bytes]:
    """A block's HTTP fields and payload; a block of another kind is a payload as it is."""
    if not fields.get("content-type", "").startswith("application/http"):
        return {}, block
    end = re.search(rb"\r?\n\r?\n", block)
    return (_fields(block[: end.start()]), block[end.end() :]) if end else (_fields(block), b"")


def _parse(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at a place, where it ends, and what is wrong. A whole record with a wrong digest has an end too."""
    line = _VERSION.match(data, at)
    if not line:
        return None, 0, "no version line"
    end = re.compile(rb"\r?\n\r?\n").search(data, line.end() - 2)
    if not end:
        return None, 0, "header without an end"
    if _VERSION.search(data, line.end(), end.start()):
        return None, 0, "version line within a header"
    fields = _fields(data[line.end() : end.start()])
    if not fields.get("content-length", "").isdigit():
        return None, 0, "no length"
    low = end.end()
    high = low + int(fields["content-length"])
    close = re.compile(rb"\r?\n\r?\n|\Z").match(data, high) if high <= len(data) else None
    if not close:
        return None, 0, "length beyond the record"
    http, payload = _body(data[low:high], fields)
    digest = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") != "revisit" and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
        return None, close.end(), "wrong digest"
    return {"fields": fields, "http": http, "payload": payload}, close.end(), ""


def _next(pattern: re.Pattern, data: bytes, at: int) -> int:
    found = pattern.search(data, at)
    return found.start() if found else len(data)


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The content of the compressed member at a place, where it ends, and what is wrong. Only its own bytes are read, but for a part of STEP."""
    unzip, parts, place = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof and place < len(data):
            parts.append(unzip.decompress(data[place : place + STEP]))
            place += STEP
    except zlib.error:
        return b"", 0, "member can't be decompressed"
    if not unzip.eof:
        return b"", 0, "member without an end"
    return b"".join(parts), min(place, len(data)) - len(unzip.unused_data), ""


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """('record', at, length, record) and ('gap', at, length, reason) in the order of an archive's bytes.

    Records of a compressed member have the member's place and length.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        found: list[dict] = []
        if _MEMBER.match(data, at):
            plain, end, reason = _member(data, at)
            if not reason:
                inner = list(salvage(plain))
                found = [x[3] for x in inner if x[0] == "record"]
                reason = next((x[3] for x in inner if x[0] == "gap"), "")
        else:
            record, end, reason = _parse(data, at)
            found = [record] if record else []
        if found or not reason:
            if bad is not None:
                yield "gap", bad, at - bad, why
                bad = None
            for x in found:
                yield "record", at, end - at, x
            if reason:
                yield "gap", at, end - at, reason
            at = end
            continue
        if bad is None:
            bad, why = at, reason
        # A whole but wrong record is left as one; else the next thing that looks like a beginning.
        at = end or min(_next(_VERSION, data, at + 1), _next(_MEMBER, data, at + 1))
    if bad is not None:
        yield "gap", bad, len(data) - bad, why


COLUMNS = "archive string, kind string, at long, length long, record_id string, record_type string, target string, refers_to string, payload_digest string, content_length long, payload binary, reason string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, COLUMNS.split(", "), strict=True)])
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            for kind, at, length, what in salvage(content.as_py()):
                row = {"archive": path.as_py(), "kind": kind, "at": at, "length": length}
                if kind == "gap":
                    row["reason"] = what
                else:
                    f = what["fields"]
                    size = what["http"].get("content-length", "")
                    row |= {"record_id": f.get("warc-record-id"), "record_type": f.get("warc-type"), "target": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to"), "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "content_length": int(size) if size.isdigit() else len(what["payload"]), "payload": what["payload"]}
                    held += len(what["payload"])
                rows.append(row)
                if held > 4 << 20 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records and gaps of all archives under a path, as COLUMNS."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_rows, COLUMNS)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as archives to the shared folder and read again: COLUMNS."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least_bytes)
    return read(spark, path)


def with_gaps(found: DataFrame) -> DataFrame:
    """The records of found (as read gives it), but for their payloads, and the quarantined bytes of their archives as gap_bytes.

    found is written once: records and the gap log are both taken from that table.
    """
    kept = written(found.drop("payload"), "archives")
    gaps = kept.filter("kind = 'gap'").groupBy(F.col("archive").alias("_a")).agg(F.sum("length").alias("_g"))
    return kept.filter("kind = 'record'").join(gaps, F.col("archive") == F.col("_a"), "left").withColumn("gap_bytes", F.coalesce("_g", F.lit(0).cast("long"))).drop("_a", "_g")


#: What is read back: digests by 20 bits (5 hex digits, 4 of base 32) at a time.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN f.first IS NULL OR p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to, CAST(0 AS BIGINT) AS gap_bytes
FROM p JOIN f ON p.html = f.html
"""
