"""WARC archives with an index of byte ranges, written and read by Spark tasks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import stage

_INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
_NAMES = ("file", "offset", "length", "page_id", "url", "payload_digest", "record_type")
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(url: str | None) -> str:
    """A URL on one line: control characters and spaces as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head alone, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    # the url may be null, which the header cannot say
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {sha}')}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_head(url)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP head, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def duplicates(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """page_id, url, html, sha, refers_to: of rows with equal payloads the smallest page_id is stored, all others refer to it."""
    held = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    held = held.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = held.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # what repeats is short, so the pages themselves move only if it is not
    return held.join(first, "sha", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first", "n")


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", most: int = 256 << 20) -> DataFrame:
    """Write one record per row below ``folder`` and return the index: file, offset, length, page_id, url, payload_digest, record_type.

    The payload is the html in UTF-8, null counts as empty. Every record is a gzip member of its own, so a byte range is
    enough to read it. Of rows with equal payloads the smallest page_id is a response, the others revisits of it; rows that repeat
    that page_id are responses too, and so are rows without a page_id. Files are closed after ``most`` bytes. A task that
    is run again writes other files; only files named in the index count, and the index lies
    in the shared folder before anything is read. ``folder`` is a URI that all executors reach. An empty
    table has an empty index. Other columns are left out.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, name, at, rows = TaskContext.get(), None, "", 0, []
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                cols = batch.slice(a, 256)
                for i, u, text, sha, refers in zip(*[c.to_pylist() for c in cols.columns]):
                    if out is None:
                        name = f"{part.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = store.open_output_stream(f"{base}/{name}", compression=None), 0
                        info = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n".encode(), 1, mtime=0)
                        at += out.write(info) or len(info)
                    b32 = base64.b32encode(bytes.fromhex(sha)).decode()
                    member = gzip.compress(record(i, u, (text or "").encode(), b32, refers, date), 1, mtime=0)
                    out.write(member)
                    rows.append((name, at, len(member), i, u, b32, "response" if refers is None else "revisit"))
                    at += len(member)
                    if at >= most:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, _KINDS)], names=list(_NAMES))

    return stage(duplicates(pages, page, url, html).select("page_id", "url", "html", "sha", "refers_to").mapInArrow(local, _INDEX))


def read(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records of the given index rows: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, sound.

    Rows are sorted by place within stretches of ``most`` bytes of a file; neighbours no more
    than ``gap`` bytes apart are fetched in one read, of up to ``most`` bytes unless a single record is longer. ``payload`` is null for a revisit,
    ``payload_bytes`` and ``payload_digest`` are those of the full payload. ``sound`` tells whether
    digest and length of a stored payload agree with its headers.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, handle, run = None, None, []

        def fetch() -> Iterator[pa.RecordBatch]:
            start = run[0][0]
            data = handle.read_at(run[-1][0] + run[-1][1] - start, start)
            rows = []
            for at, size, page_id, url in run:
                head, http, payload = parse(gzip.decompress(data[at - start:at - start + size]))
                said, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                full = head["WARC-Type"] == "response"
                refers = None if full else int(head["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
                rows.append((page_id, url, payload if full else None, length, said, head["WARC-Type"], refers, not full or (digest(payload) == said and len(payload) == length)))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"])

        for batch in batches:
            for file, at, size, page_id, url in zip(*[c.to_pylist() for c in batch.columns]):
                end = run[-1][0] + run[-1][1] if run else 0
                if run and (file != name or at > end + gap or at + size - run[0][0] > most):
                    yield from fetch()
                    run = []
                if file != name:
                    if handle is not None:
                        handle.close()
                    name, handle = file, store.open_input_file(f"{base}/{file}")
                run.append((at, size, page_id, url))
        if run:
            yield from fetch()
        if handle is not None:
            handle.close()

    placed = index.withColumn("_s", F.floor(F.col("offset") / most)).repartition("file", "_s").sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length", "page_id", "url").mapInArrow(local, _READ)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives below the cluster's shared one, as a URI."""
    path = shared_dir(pages.sparkSession)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
