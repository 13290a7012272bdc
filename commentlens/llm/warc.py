"""WARC archives: a writer of response and revisit records and a reader that salvages damaged files.

Each record is a gzip member of its own. Archives are written by Spark's text sink, so they reach any
store that Spark writes to and a lost task is simply run again: a row is one member's bytes, and rows
are separated by an empty member, which readers skip. The reader checks every member (header, length,
checksum) and every record in it (version line, length, digests of the block and of the payload). After a failed check it goes
on at the next member or version line that passes, and logs the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.session import work_path, written_table

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records per archive file and bytes of a payload from which a record gets a file of its own. Both bound what one
#: task of the reader holds: a gigabyte, or one record.
FILE_RECORDS, LARGE = 2000, 1 << 19
#: Bytes of a member that are unpacked at once.
PIECE = 1 << 13
_MAGIC = b"\x1f\x8b\x08"
_GAP_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(identity: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record. A revisit carries no payload, but the digest and length of the full one."""
    kind = "response" if refers_to is None else "revisit"
    # line breaks inside a url would end the header
    target = re.sub(r"[\r\n]", "", url or "")
    block = payload if refers_to is None else b""
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{identity}>", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with a constant header, so that a repeated task writes the same bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return _GAP_MEMBER[:10] + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _agrees(stated: str | None, data: bytes) -> bool:
    """Whether a digest header allows ``data``; SHA-1 in base32 or hexadecimal and SHA-256 are checked, others pass."""
    kind, _, value = (stated or "").partition(":")
    kind, value = kind.strip().lower().replace("-", ""), value.strip()
    if kind not in ("sha1", "sha256"):
        return True
    found = hashlib.new(kind, data).digest()
    return value.lower() == found.hex() or value.rstrip("=").upper() == base64.b32encode(found).decode().rstrip("=")


def _joined_chunks(body: bytes) -> bytes | None:
    """The content of a body in chunks, or None if it is no such body."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return None
        at = line + 2 + int(size, 16)
        if not int(size, 16):
            return b"".join(parts)
        parts.append(body[line + 2:at])
        if body[at:at + 2] != b"\r\n":
            return None
        at += 2


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What a record carries: of an HTTP message the body behind its header, else the block."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block
    stop = re.search(rb"\r?\n\r?\n", block)
    return block[stop.end():] if stop else b""


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record at ``at``, or None if a check fails.

    A header line that begins with white space goes on with the line before. The block digest is that of the block, the
    payload digest of a response or resource that of its payload, as it was sent or with its chunks joined.
    """
    start = _VERSION_LINE.match(data, at)
    stop = data.find(b"\r\n\r\n", at)
    if not start or stop < 0:
        return None
    headers, name = {}, None
    for line in data[start.end():stop].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name is not None:
            headers[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        name = key.decode("utf-8", "replace").strip().lower()
        headers[name] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    if not _agrees(headers.get("warc-block-digest"), block):
        return None
    if headers.get("warc-type") in ("response", "resource") and "warc-segment-number" not in headers:
        payload, stated = payload_of(headers, block), headers.get("warc-payload-digest")
        if not _agrees(stated, payload):
            whole = _joined_chunks(payload) if payload is not block else None
            if whole is None or not _agrees(stated, whole):
                return None
    return headers, block, end + 4


def unpacked(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``, or None if it is cut short or fails its checks.

    The member is fed in pieces: the rest of the file is never copied, so a file of many members takes linear time.
    """
    unpacker, parts, view = zlib.decompressobj(31), [], memoryview(data)
    end = at
    try:
        while not unpacker.eof and end < len(data):
            parts.append(unpacker.decompress(view[end:end + PIECE]))
            end = min(end + PIECE, len(data))
    except zlib.error:
        return None
    return (b"".join(parts), end - len(unpacker.unused_data)) if unpacker.eof else None


def records_in(plain: bytes) -> tuple[list[tuple[dict[str, str], bytes]], bool]:
    """The records of a member's content that pass, and whether nothing else is in it."""
    found, at, clean = [], 0, True
    while at < len(plain):
        one = parsed(plain, at)
        if one:
            found.append(one[:2])
            at = one[2]
            continue
        clean = False
        line = _VERSION_LINE.search(plain, at + 1)
        if not line:
            break
        at = line.start()
    return found, clean


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """All that passes the checks as ('record', offset, length, headers, block), and ('gap', offset, length, {}, b'').

    The offset is that of a record's gzip member or, in plain archives, of the record itself. A member
    that unpacks but holds more than valid records is a gap, though the valid ones are given.
    """
    at = gap = 0
    line = -1  # the next version line, once searched for
    while at < len(data):
        found: list = []
        end, clean = at, False
        if data.startswith(_MAGIC, at):
            inside = unpacked(data, at)
            if inside:
                end = inside[1]
                found, clean = records_in(inside[0])
        else:
            one = parsed(data, at)
            if one:
                found, end, clean = [one[:2]], one[2], True
        if clean and gap < at:
            yield "gap", gap, at - gap, {}, b""
        yield from (("record", at, end - at, *f) for f in found)
        if clean:
            gap = end
        elif end == at:
            if line <= at:
                match = _VERSION_LINE.search(data, at + 1)
                line = match.start() if match else len(data)
            # no magic number behind the version line matters
            magic = data.find(_MAGIC, at + 1, line + len(_MAGIC))
            end = magic if magic >= 0 else line
        at = end
    if gap < len(data):
        yield "gap", gap, len(data) - gap, {}, b""


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 200):
            ids, urls, bodies, refers = (batch.column(k).slice(low, 200).to_pylist() for k in range(4))
            out = [
                member(record("null" if i is None else str(i), u, (b or "").encode(), None if r is None else str(r)))
                for i, u, b, r in zip(ids, urls, bodies, refers, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   file_records: int = FILE_RECORDS) -> None:
    """One record per row. Of equal payloads the one with the largest id is the response, others revisit it.

    A null payload is empty. A null id is the smallest; if a group has no other, all its rows are
    responses. Rows that repeat the largest id are all responses. Other columns are ignored.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha2("html", 256))
    # only payloads that several pages have need a response to refer to
    groups = rows.groupBy("key").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "last")
    groups = written_table(groups, "warc-groups")
    refers = F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.join(groups, "key", "left").select("id", "url", "html", refers.alias("refers_to"))
    # a revisit has no block, however large its payload
    large = (F.octet_length("html") > LARGE) & F.col("refers_to").isNull()

    def save(part: DataFrame, per_file: int, mode: str) -> None:
        members = part.mapInArrow(_members, "member binary")
        (
            members.select(F.col("member").cast("string").alias("value")).write.mode(mode)
            .option("lineSep", _GAP_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
            .option("maxRecordsPerFile", per_file).text(path)
        )

    save(rows.where(~large), file_records, "error")
    if not pages.where(F.octet_length(pages[html_col]) > LARGE).isEmpty():
        save(rows.where(large), 1, "append")


_READ = pa.schema([
    ("file", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("refers_to", pa.string()), ("payload", pa.binary()),
])


def _salvaged(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                name = batch.column(0)[i].as_py()
                rows: list = []
                for kind, offset, length, headers, block in salvage(batch.column(1)[i].as_py()):
                    if kind == "gap":
                        rows.append((name, kind, offset, length, *[None] * 7))
                    else:
                        block = payload_of(headers, block)
                        full = headers.get("x-payload-length") or str(len(block))
                        rows.append((
                            name, kind, offset, length, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"),
                            headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(full) if full.isdigit() else None,
                            headers.get("warc-refers-to"), block if with_payload else None,
                        ))
                    if len(rows) >= 500:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all files under ``path``: file, kind (record or gap), offset, length and, of records,
    record_type, record_id, target_uri, payload_digest (base32 SHA-1), payload_bytes (of the full payload), refers_to, payload.

    The payload of an HTTP message is its body. A file is read by one task and must be below 2 GB, which Spark's reader of
    whole files can hold; the writer's files hold ``FILE_RECORDS`` records, or one large one.
    An empty file gives no row, a file without a valid record one gap.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = "file string, kind string, offset long, length long, record_type string, record_id string, target_uri string, " \
            "payload_digest string, payload_bytes long, refers_to string, payload binary"
    return files.mapInArrow(_salvaged(with_payload), kinds)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and returns what the reader finds there, one row per page.

    Gaps are logged in a table ``warc-gaps-*`` of the shared folder: file, offset and length.
    """
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    read = written_table(read_archives(spark, path, with_payload=False), "warc-read")
    written_table(read.where("kind = 'gap'").select("file", "offset", "length"), "warc-gaps")
    found = read.where("kind = 'record'")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    return found.select(
        number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"),
    )
