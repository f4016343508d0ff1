"""WARC archives: write one record per page, read them back with a reader that salvages damaged files.

Writing: pages with equal payloads are found by digest; the one with the largest id becomes a ``response`` record with the
payload, the others ``revisit`` records that refer to it. Records are gzip members of their own, in archives of bounded
size, written by the executors through ``write_archives`` to a folder all of them share (a temporary name first, then a
rename, so that a task that runs again leaves one file).

Reading: each member is checked (gzip checksum, version line, header block, declared length, payload digest). After a
failed check the reader looks for the next gzip member or version line that opens a valid record, goes on there, and logs
the bytes between as a quarantined gap.

Defined results: a null html is an empty payload; empty payloads are equal payloads like any other; rows with a null id
get records of their own kind of id (``null``) and come back with a null id; an empty table writes no archive; further columns
are ignored; a repeated id is written as often as it stands there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.session import shared_root

# Marks of the file format (fixed values).
VERSION_LINE = b"WARC/1.1\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 8 << 20
PIECE_BYTES = 64 << 10


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, n: int = 0) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def build_record(page_id, url, payload: bytes, length: int, digest: str, refers_to) -> bytes:
    """One record, not compressed. A revisit has no payload but names its length and digest."""
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", RECORD_DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(length)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    headers.append(("Content-Type", "text/html; charset=utf-8"))
    headers.append(("Content-Length", str(len(payload))))
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return VERSION_LINE + head + b"\r\n" + payload + b"\r\n\r\n"


def compress(record: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record that starts at ``at``. ValueError where a check fails."""
    if not data.startswith(VERSION_LINE, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header block does not end")
    headers = {}
    for line in data[at + len(VERSION_LINE) : stop].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        headers[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    payload = data[begin:end]
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers.get("warc-type") == "response" and stated and payload_digest(payload) != stated:
        raise ValueError("payload digest differs")
    return headers, payload, end + 4


def open_member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``at`` and the offset after it; ValueError where it is damaged."""
    opener = zlib.decompressobj(31)
    view, content, place = memoryview(data), [], at
    try:
        while not opener.eof and place < len(data):  # in pieces: what is unused after the end is copied
            content.append(opener.decompress(view[place : place + PIECE_BYTES]))
            place = min(place + PIECE_BYTES, len(data))
    except zlib.error as failure:
        raise ValueError(str(failure)) from failure
    if not opener.eof:
        raise ValueError("member is cut off")
    return b"".join(content), place - len(opener.unused_data)


def read_at(data: bytes, at: int) -> tuple[list[Record], int]:
    if data.startswith(GZIP_MAGIC, at):
        content, end = open_member(data, at)
        records, inner = [], 0
        while inner < len(content):
            headers, payload, inner = parse_record(content, inner)
            records.append(Record(at, end, headers, payload))
        return records, end
    headers, payload, end = parse_record(data, at)
    return [Record(at, end, headers, payload)], end


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Records of an archive in order; a gap is (start, end, reason of the first failure)."""
    at = 0
    marks = re.compile(re.escape(GZIP_MAGIC) + b"|" + re.escape(VERSION_LINE))
    while at < len(data):
        try:
            records, at = read_at(data, at)
            yield from records
            continue
        except ValueError as failure:
            reason, start = str(failure), at
        found, search = None, at + 1
        while found is None:
            mark = marks.search(data, search)
            if mark is None:
                break
            try:
                found = read_at(data, mark.start())
            except ValueError:
                search = mark.start() + 1
        yield start, len(data) if found is None else mark.start(), reason
        if found is None:
            return
        yield from found[0]
        at = found[1]


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: null for responses. Equal payloads share length and two digests."""
    keyed = pages.select(
        "page_id", "url", "html", F.octet_length(F.coalesce("html", F.lit(""))).alias("n"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_key"))
    last = (keyed.filter(F.col("n") >= min_bytes).groupBy("payload_key").agg(F.max("page_id").alias("last_id")))
    return keyed.join(last, "payload_key", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") < F.col("last_id"), F.col("last_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the marked pages below ``folder`` (a uri that all executors reach); archive, records, bytes written, content.

    Where tasks can open ``folder`` themselves, archives are files there and content is null. In stores that only Spark's own file
    systems open, content holds the archive: store the result as a table and hand that to ``read_archives``.
    """
    as_files = opens(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder) if as_files else (None, None)
        members: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.warc.gz"
            if as_files:
                with fs.open_output_stream(f"{root}/.{name}.part", compression=None) as out:
                    for member in members:
                        out.write(member)
                fs.move(f"{root}/.{name}.part", f"{root}/{name}")
            return pa.record_batch({"archive": [name], "records": pa.array([len(members)], pa.int64()), "bytes": pa.array([size], pa.int64()),
                                    "content": pa.array([None if as_files else b"".join(members)], pa.binary())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                payload = (html.as_py() or "").encode()
                kept = payload if refers_to.as_py() is None else b""
                members.append(compress(build_record(page_id.as_py(), url.as_py(), kept, len(payload),
                                                     payload_digest(payload), refers_to.as_py())))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield close()
                    members, size = [], 0
        if members:
            yield close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(
        write, "archive string, records long, bytes long, content binary")


def opens(folder: str) -> bool:
    """Whether tasks can write files below a uri without Spark."""
    try:
        pa.fs.FileSystem.from_uri(folder)
    except (ValueError, OSError, NotImplementedError):  # a scheme that is not known, or not built in
        return False
    return True


def read_archives(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """Every record and every gap below ``folder``.

    archive, start, end, kind (response, revisit, gap, or another record type), page_id, refers_to, url, payload_bytes,
    payload_digest, payload (null for revisits and gaps), reason (of a gap). With ``archives`` (column archive, maybe content) only files
    listed there are read: what an abandoned task attempt left behind is not. Archives whose content is listed are read from the list.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if archives is not None:
        files = files.join(archives.select("archive").distinct(), "archive", "left_semi")
        if "content" in archives.columns:
            files = files.unionByName(archives.filter("content IS NOT NULL").select("archive", "content"))

    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive"), batch.column("content")):
                rows = []
                size = 0
                for found in salvage(content.as_py()):
                    if isinstance(found, tuple):
                        start, end, reason = found
                        rows.append((archive.as_py(), start, end, "gap", None, None, None, None, None, None, reason))
                    else:
                        h = found.headers
                        kind = h.get("warc-type", "")
                        length = h.get("x-payload-length", "")
                        rows.append((
                            archive.as_py(), found.start, found.end, kind, number(h.get("warc-record-id")),
                            number(h.get("warc-refers-to")), h.get("warc-target-uri"),
                            int(length) if length.isdigit() else len(found.payload),
                            h.get("warc-payload-digest", "").removeprefix("sha1:"),
                            None if kind == "revisit" else found.payload, None))
                        size += len(found.payload)
                    if size >= 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    return files.mapInArrow(read, RECORD_COLUMNS)


RECORD_COLUMNS = ("archive string, start long, end long, kind string, page_id long, refers_to long, url string, "
                  "payload_bytes long, payload_digest string, payload binary, reason string")


def pack(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.strip().split() for c in RECORD_COLUMNS.split(",")]
    return pa.record_batch({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives below the shared one."""
    folder = f"{shared_root(spark)}/warc-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()
