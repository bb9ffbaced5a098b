"""WARC archives: a writer made of text columns, and a reader that salvages what lies behind damaged bytes.

The writer is Spark's own text writer, so its files are committed like any table. The reader takes plain archives and
those of gzip members, a file to a task; it reads by position in windows, checks every record and, where a check fails,
looks for the next member or version line that passes. What it skips is given as rows of byte gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, shared_dir

VERSION, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
#: Bytes that are read at once; the longest header of a record; rows that the reader gives at once.
WINDOW, HEADER, ROWS = 1 << 20, 1 << 16, 256
#: Stores that tasks open by position; files of any other come whole from Spark's own reader.
OPENED = ("file", "hdfs", "s3", "gs")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MARK = re.compile(re.escape(GZIP) + b"|" + re.escape(VERSION))
_SCHEMA = "path string, offset long, length long, gap string, record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, headers map<string,string>, payload binary"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in base32, upper case: five hex digits at a time are four letters."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uri(*parts: Column) -> Column:
    """A record id that the same parts always give."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, b, n) for b, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def page_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, html, n_bytes, digest, first: the smallest page_id of the same
    payload, if that has ``least`` bytes and other rows share it, else null.

    Payloads are told apart by length, SHA-1 and another 64 bits. Each task counts its own copies before the shuffle;
    only payloads that come again are joined, and Spark splits those that make up a large part.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("n_bytes"), base32_sha1(F.encode(payload, "utf-8")).alias("digest"), F.xxhash64(payload).alias("other"))
    key = ["n_bytes", "digest", "other"]
    again = materialize(rows.where(F.col("n_bytes") >= least).groupBy(*key).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    return rows.join(again, key, "left").drop("other")


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int = 10_000) -> None:
    """A record for each row of ``pages`` (page_id, url, html) in plain archives below ``folder``.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest page_id is a response (each of them,
    if rows repeat that page_id); the others are revisits that refer to it, null page_ids among them. If all page_ids of
    a payload are null, all are responses, as are shorter payloads. Null html is an empty payload, a null url an empty
    URI; other columns are ignored; without rows there are no records. A file has at most ``per_file`` records.
    """
    rows = page_roles(pages, least)
    page, line = F.coalesce(F.col("page_id").cast("string"), F.lit("")), lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _uri(F.when(revisit, "revisit").otherwise("response"), page, F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_REVISIT)), line("WARC-Refers-To", _uri(F.lit("response"), F.col("first").cast("string"), F.col("digest"))), line("WARC-Truncated", F.lit("length")))).otherwise(""),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", page)).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("record")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(folder)


class _Broken(Exception):
    """Why bytes are not a record."""


def _head(file: pa.NativeFile, at: int) -> tuple[dict[str, str], int]:
    """The named fields of the record at ``at`` and the first byte of its block."""
    size = 2048
    while True:
        raw = file.read_at(size, at)
        if not raw.startswith(VERSION):
            raise _Broken("no version line")
        if (end := raw.find(b"\r\n\r\n")) >= 0:
            break
        if len(raw) < size or size >= HEADER:
            raise _Broken("header without end")
        size *= 4
    lines, fields = raw[:end].split(b"\r\n"), {}
    if not re.fullmatch(rb"WARC/1\.[0-9]", lines[0]):
        raise _Broken("no version line")
    for one in lines[1:]:
        if one[:1] in b" \t" and fields:
            fields[list(fields)[-1]] += " " + one.strip().decode("utf-8", "replace")
        elif b":" not in one:
            raise _Broken("field without colon")
        else:
            name, value = one.split(b":", 1)
            fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return fields, at + end + 4


def _digest(file: pa.NativeFile, begin: int, end: int) -> str:
    sha = hashlib.sha1()
    for at in range(begin, end, WINDOW):
        sha.update(file.read_at(min(WINDOW, end - at), at))
    return base64.b32encode(sha.digest()).decode()


def _record(file: pa.NativeFile, at: int, payloads: bool) -> tuple[dict, int]:
    """The record at ``at``, all checks passed, and the byte behind it; whatever is wrong raises ``_Broken``."""
    fields, begin = _head(file, at)
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        raise _Broken("no length or type")
    end = begin + int(fields["content-length"])
    if end + 4 > file.size():
        raise _Broken("block is cut off")
    if file.read_at(4, end) != b"\r\n\r\n":
        raise _Broken("no end of record behind the block")
    kind, body, stated = fields["warc-type"], begin, None
    if fields.get("content-type", "").startswith("application/http") and kind in ("response", "revisit"):
        http = file.read_at(min(HEADER, end - begin), begin)
        cut = http.find(b"\r\n\r\n")
        if cut < 0:
            raise _Broken("HTTP header without end")
        body = begin + cut + 4
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http[:cut])
        stated = int(length[1]) if length else None
    for name, first in (("warc-block-digest", begin), ("warc-payload-digest", body)):
        algorithm, _, value = fields.get(name, "").partition(":")
        if algorithm.lower() == "sha1" and not (kind == "revisit" and first == body) and _digest(file, first, end) != value.upper():
            raise _Broken(f"{name} does not match")
    digest = fields.get("warc-payload-digest", "").partition(":")[2].upper() if kind == "revisit" else _digest(file, body, end)
    row = {
        "record_id": fields.get("warc-record-id"),
        "record_type": kind,
        "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": stated if kind == "revisit" else end - body,
        "payload_digest": digest or None,
        "headers": list(fields.items()),
        "payload": file.read_at(end - body, body) if payloads else None,
    }
    return row, end + 4


def _member(file: pa.NativeFile, at: int) -> tuple[bytes, int]:
    """The bytes of the gzip member at ``at`` and the byte behind it."""
    inflate, out, place = zlib.decompressobj(31), [], at
    begun = b""
    while not inflate.eof:
        raw = file.read_at(WINDOW, place)
        if not raw:
            raise _Broken("member is cut off")
        place += len(raw)
        try:
            out.append(inflate.decompress(raw))
        except zlib.error as error:
            raise _Broken(f"member: {error}") from None
        begun = begun if len(begun) >= len(VERSION) else (begun + out[-1])[: len(VERSION)]
        if not VERSION.startswith(begun[: len(VERSION)]):
            raise _Broken("member without version line")
    return b"".join(out), place - len(inflate.unused_data)


def _unit(file: pa.NativeFile, at: int, payloads: bool) -> tuple[list[dict], int]:
    """What stands at ``at``: a plain record, or a gzip member of whole records."""
    if file.read_at(3, at) != GZIP:
        row, end = _record(file, at, payloads)
        return [row], end
    text, end = _member(file, at)
    inner, rows, place = pa.BufferReader(text), [], 0
    while place < len(text):
        row, place = _record(inner, place, payloads)
        rows.append(row)
    return rows, end


def _next_mark(file: pa.NativeFile, at: int) -> int:
    """The first byte from ``at`` on where a member or a version line may begin, or the end of the file."""
    overlap = len(VERSION) - 1
    while at < file.size():
        raw = file.read_at(WINDOW + overlap, at)
        if found := _MARK.search(raw):
            return at + found.start()
        at += WINDOW
    return file.size()


def salvage(file: pa.NativeFile, payloads: bool = True) -> Iterator[dict]:
    """Rows of one archive in the order of its bytes: records, and gaps with the reason why their first byte failed.

    The rows cover the file without overlap; a member of several records gives them all its offset and length.
    """
    at, gap, reason = 0, None, ""
    while at < file.size():
        try:
            rows, end = _unit(file, at, payloads)
        except _Broken as error:
            gap, reason = (at, str(error)) if gap is None else (gap, reason)
            at = _next_mark(file, at + 1)
            continue
        if gap is not None:
            yield {"offset": gap, "length": at - gap, "gap": reason}
            gap = None
        for row in rows:
            yield {"offset": at, "length": end - at, **row}
        at = end
    if gap is not None:
        yield {"offset": gap, "length": file.size() - gap, "gap": reason}


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives below ``folder``, plain or gzip members in any mixture, and for each gap.

    path, offset and length (bytes in the file) and, for records: record_id, record_type, refers_to, target_uri,
    payload_bytes, payload_digest (computed from the bytes; a revisit's are those that it states), headers (names in
    lower case), payload (null if ``payloads`` is off). For gaps: why the first byte of the gap is no valid record.
    Records must have a version line, fields, type, length, the blank lines at the end and, where they state SHA-1
    digests, match them. Empty files and a folder without files give no row. A task reads its files by position in
    windows and holds one record, or one gzip member, at a time; files of stores that only Spark opens come whole from
    its binary reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    scheme = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(hadoop).getUri().getScheme()
    opened = scheme in OPENED
    listed = files.select("path", "length") if opened else files.select("path", "length", "content")
    types = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *[(c, pa.string()) for c in ("gap", "record_id", "record_type", "refers_to", "target_uri")], ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows, held = [], 0
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                if opened:
                    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                    file = store.open_input_file(place)
                else:
                    file = pa.BufferReader(batch.column(2)[k].as_buffer())
                with file:
                    for row in salvage(file, payloads):
                        rows.append({"path": path, **row})
                        held += len(row.get("payload") or b"")
                        if len(rows) >= ROWS or held > WINDOW:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    return listed.mapInArrow(run, _SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Records with target_page: X-Page-Id of the response that a revisit refers to, null where that is not there.

    Responses that a revisit names are taken once each; the payload size of a revisit is that of its response if found.
    Only revisits are joined, with a table of one row an id, so Spark can split the revisits of a much copied page.
    """
    page = F.element_at("headers", F.lit("x-page-id"))
    rows = records.where("gap IS NULL").select("record_id", "record_type", "refers_to", page.alias("page"), "payload_bytes", "payload_digest")
    alone = rows.where("refers_to IS NULL").withColumn("target_page", F.lit(None).cast("string"))
    named = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page").alias("target_page"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("digest"))
    named = materialize(named.groupBy("refers_to").agg(F.min("target_page").alias("target_page"), F.min("full_bytes").alias("full_bytes")), "responses")
    joined = rows.where("refers_to IS NOT NULL").join(named, "refers_to", "left")
    return alone.unionByName(joined.withColumn("payload_bytes", F.coalesce("full_bytes", "payload_bytes")).drop("full_bytes"))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives below the shared folder and read back from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    found = resolved(materialize(read_archives(spark, folder, payloads=False), "records"))
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("page").cast(kind).alias("page_id"), F.col("payload_bytes").cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("target_page").cast(kind)).alias("refers_to"))


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT page_id, payload_bytes, first, list_transform(range(0, 8), lambda k: CAST(concat('0x', substring(h, CAST(1 + 5 * k AS INT), 5)) AS BIGINT)) AS five FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((five[1 + k // 4] >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
