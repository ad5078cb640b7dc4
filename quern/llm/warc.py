"""WARC archives: a native writer with revisit records, and a reader that salvages damaged archives.

The writer builds each record as one string and lets Spark's text sink end it by CRLF CRLF, so archives land in
any store that Spark writes to, under its commit protocol. The reader gets whole files by Spark's binary source
(the writer bounds an archive's bytes; keep others well below 2 GB) and parses them in one pass. A record that fails a check is
quarantined: the reader looks for the next version line or gzip member that parses, goes on from there, and
reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import arrows
from quern.plans import scratch

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BROADCAST_ROWS = 200_000
MAX_HEADER = 1 << 20
MAX_MEMBER = 1 << 28  # bytes that a gzip member may inflate to
CHUNK = 1 << 14  # bytes of a gzip member that are read at once
ARCHIVE = 1 << 26  # bytes of records in an archive
_MARK = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_GZIP = b"\x1f\x8b\x08"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string or binary column, by built-in functions."""
    digest = F.sha1(payload)
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def plan_records(pages: DataFrame, page: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to each row.

    Of rows with equal payloads of at least `least` bytes, that with the smallest id is the response and others
    revisit it; rows that repeat this id are responses too. A null payload is empty; rows with a null id rank
    last, and are responses where no row of their payload has an id. Only digests that occur twice or more are
    joined back (broadcast up to BROADCAST_ROWS, else by a join whose hot digests Spark splits). Columns of the names
    that are added are replaced. Payloads of any length are hashed whole; an empty table gives an empty one.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": base32_sha1(body)})
    twice = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("__q_n"), F.min(page).alias("__q_first")).where("__q_n > 1 AND __q_first IS NOT NULL")
    twice = scratch.cut(twice.select(F.col("payload_digest").alias("__q_digest"), "__q_first"), "payloads")
    twice = F.broadcast(twice) if scratch.fits(twice, BROADCAST_ROWS) else twice
    rows = rows.join(twice, (F.col("payload_digest") == F.col("__q_digest")) & (F.col("payload_bytes") >= least), "left")
    again = F.col("__q_first").isNotNull() & ~F.col(page).eqNullSafe(F.col("__q_first"))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("__q_first"))}).drop("__q_digest", "__q_first")


def write(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", size: int = ARCHIVE) -> None:
    """Writes a record for each row to archives under `path`. See plan_records for ties and nulls; a null url gives
    no target, and line ends in a url are dropped. An empty table gives archives without records.

    Payloads are dealt into classes by size, a factor of 16 each, and a class's archives hold as many records as
    surely fit in about `size` bytes; a larger record has an archive of its own. So no archive grows with the input. Each class is a
    folder under `path`; the classes are counted first, and one without a row isn't written.
    """
    rows = plan_records(pages.select(page, url, html), page, html, least)
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.coalesce(F.col(html), F.lit(""))).otherwise(""))
    rows = rows.withColumn("__q_block", block)
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), name(F.col(page)),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.translate(F.col(url), "\r\n", ""), F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("__q_block").cast("string"),
        F.lit("\r\n\r\n"), F.col("__q_block"),
    )
    kind = F.least(F.greatest(F.floor(F.log2(F.octet_length(F.coalesce(F.col(html), F.lit(""))) + 1) / 4).cast("int"), F.lit(2)), F.lit(7))
    kinds = sorted(r.kind for r in pages.select(kind.alias("kind")).distinct().collect())  # six at most
    for k in kinds or [2]:
        records_per_file = max(1, size >> (4 * k + 4))
        rows.where(kind == k).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(f"{path}/class={k}")


def _parse(data: bytes, at: int) -> tuple[int, dict[bytes, bytes], memoryview] | str:
    """The record at `at`: (end, fields, block), or what is wrong with it."""
    if not (mark := _MARK.match(data, at)):
        return "no version line"
    fields: dict[bytes, bytes] = {}
    line, last = mark.end(), mark.end() + MAX_HEADER
    while (stop := data.find(b"\r\n", line, last)) != line:
        if stop < 0:
            return "header doesn't end"
        key, colon, value = data[line:stop].partition(b":")
        if not colon:  # so that each header is read no further than to the next version line
            return "field without a name"
        fields[key.strip().lower()] = value.strip()
        line = stop + 2
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18 or b"warc-type" not in fields or b"warc-record-id" not in fields:
        return "mandatory field is missing or malformed"
    begin, end = line + 2, line + 2 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "block is cut off or of another length"
    return end + 4, fields, memoryview(data)[begin:end]


def _payload(fields: dict[bytes, bytes], block: memoryview) -> tuple[bytes | memoryview, dict[bytes, bytes]]:
    if not fields.get(b"content-type", b"").startswith(b"application/http"):
        return block, {}
    head, _, _ = bytes(block[:MAX_HEADER]).partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return block[len(head) + 4 :], http


def _check(fields: dict[bytes, bytes], block: memoryview, payloads: bool) -> dict | str:
    """What a parsed record says, or which check it fails."""
    payload, http = _payload(fields, block)
    kind, said = fields[b"warc-type"].decode("latin-1"), fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1").upper()
    size = len(payload)
    if kind == "revisit":
        size = int(http[b"content-length"]) if http.get(b"content-length", b"").isdigit() else None
    elif said and said != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        return "payload digest differs"
    return {
        "record_type": kind, "record_id": fields[b"warc-record-id"].decode("utf-8", "replace"), "target": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None,
        "payload_digest": said or None, "payload_bytes": size, "refers_to": fields[b"warc-refers-to"].decode("utf-8", "replace") if b"warc-refers-to" in fields else None,
        "payload": bytes(payload) if payloads and kind != "revisit" else None,
    }


def _member(data: memoryview, at: int) -> tuple[int, bytes, str]:
    """The gzip member at `at`: its end, its content as far as it can be read, and what is wrong with it, if anything.

    It is fed in chunks of CHUNK bytes, so that the rest of the archive isn't copied and at most MAX_MEMBER bytes come
    out of it.
    """
    unzip, out, size = zlib.decompressobj(31), [], 0
    while not unzip.eof:
        if at >= len(data):
            return at, b"".join(out), "gzip member is cut off"
        chunk, before = data[at : at + CHUNK], unzip.copy()
        try:
            out.append(unzip.decompress(chunk, MAX_MEMBER + 1 - size))
        except zlib.error as error:
            with contextlib.suppress(zlib.error):  # up to the damage
                for i in range(0, len(chunk), 64):
                    out.append(before.decompress(chunk[i : i + 64], MAX_MEMBER))
            return at, b"".join(out), f"gzip: {str(error)[:60]}"
        size += len(out[-1])
        if size > MAX_MEMBER:
            return at, b"".join(out), "gzip member is too large"
        at += len(chunk) - len(unzip.unused_data)
    return at, b"".join(out), ""


class _Places:
    """Where records and gzip members may begin, asked for in ascending order."""

    def __init__(self, data: bytes, members: bool):
        self.data = data
        self.zipped = 0 if members else len(data)

    def next(self, at: int) -> int:
        data = self.data
        if self.zipped < at:  # looked for once, however many records are damaged before it
            found = data.find(_GZIP, at)
            self.zipped = len(data) if found < 0 else found
        while 0 <= (mark := data.find(b"WARC/", at, self.zipped)):
            if _MARK.match(data, mark):  # wherever it stands: what is before it may be cut off within a line
                return mark
            at = mark + 1
        return self.zipped


def salvage(data: bytes, members: bool = True, payloads: bool = True) -> Iterator[tuple[int, int, dict | str]]:
    """The records of an archive as (offset, length, record), and what is quarantined as (offset, length, reason).

    Plain archives and archives of gzip members of one or more records are read; spare line ends between records
    are skipped. After a failed check the search goes on at the next version line, or the next gzip member that holds a
    record. Of a member that is damaged or cut off, the records before the damage are read, and the member is a gap.
    Offsets are of the bytes in the archive; all records of a gzip member have the member's. The time is linear in the
    archive and in what its members inflate to.
    """
    at, gap, why = 0, -1, ""
    places, view = _Places(data, members), memoryview(data)
    while at < len(data):
        if data[at : at + 1] in b"\r\n" and gap < 0:
            at += 1
            continue
        found: list[tuple[int, int, dict | str]] = []
        end, reason = at, ""
        if members and data.startswith(_GZIP, at):
            end, content, reason = _member(view, at)
            inner = [x[2] for x in salvage(content, False, payloads)]
            records = [x for x in inner if isinstance(x, dict)]
            if reason:
                inner = records
            elif not records:
                reason = "gzip member holds no record"
            if records:
                found = [(at, end - at, x) for x in inner]
        else:
            parsed = _parse(data, at)
            if isinstance(parsed, str):
                reason = parsed
            else:
                said = _check(parsed[1], parsed[2], payloads)
                if isinstance(said, str):
                    reason = said
                else:
                    end, found = parsed[0], [(at, parsed[0] - at, said)]
        if found and gap >= 0:
            yield gap, at - gap, why
            gap = -1
        yield from found
        if not reason:
            at = end
            continue
        if gap < 0:
            gap, why = at, reason
        at = places.next(at + 1)
    if gap >= 0:
        yield gap, len(data) - gap, why


SCHEMA = "archive string, offset long, length long, reason string, record_type string, record_id string, target string, payload_digest string, payload_bytes long, refers_to string"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records and gaps of the archives under `path`. A gap has a reason and no record_type; a record has no
    reason. With `payloads` there is a column payload (binary; null for revisits). A file without records gives
    no row, or one gap for all of its bytes. Folders under `path` are read too."""
    schema = SCHEMA + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = pa.schema([(n, types[k]) for n, k in (x.split() for x in schema.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[dict] = []
                for offset, length, what in salvage(content.as_py(), payloads=payloads):
                    row = {"archive": archive.as_py(), "offset": offset, "length": length}
                    rows.append(row | ({"reason": what} if isinstance(what, str) else {k: v for k, v in what.items() if k in names}))
                    if len(rows) >= (64 if payloads else 4096):
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return arrows.modest(files).mapInArrow(work, schema)


def records(read_rows: DataFrame) -> DataFrame:
    return read_rows.where("record_type IS NOT NULL").drop("reason")


def gaps(read_rows: DataFrame) -> DataFrame:
    return read_rows.where("record_type IS NULL").select("archive", "offset", "length", "reason")
