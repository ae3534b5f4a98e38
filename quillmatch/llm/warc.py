"""WARC archives with dictionary compression (.warc.zst).

Each task writes archives of at most ``ARCHIVE_BYTES`` of records. An archive's first
records (at most ``SAMPLE_BYTES``) train a Zstandard dictionary, which a leading skippable
frame (magic 0x184D2A5D) holds; every record is a frame of its own, compressed with
that dictionary, so records can be read alone. Where the sample is too small to train
from, the archive has no dictionary frame. Of pages with equal payloads of
``REVISIT_BYTES`` or more, the one with the least id is a response and the others are
revisits that name it; a revisit keeps the HTTP header, whose Content-Length is the
payload's, and the payload digest.

Files go to the shared folder through its own file system, under a temporary name until
they are whole; names come from the task's number, so a task that runs again writes
the same files. Payloads are counted by digest within tasks before they are shuffled,
and only digests that occur twice are joined back, broadcast if few (``BROADCAST_ROWS``)
and by a shuffle otherwise, first to ids alone and then to pages by id and digest.

Null html is an empty payload; a null url is an empty target. Null ids are no ids: such
a page is never one that others revisit, and is itself a response. Rows that repeat the
least id of a payload are all responses. Empty tables give no archives. Other columns are
not read. One record is held in memory at a time, besides the sample.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import as_bytes, shared_folder, stored, table, tidy

ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 64 << 20, 4 << 20, 64 << 10, 6
REVISIT_BYTES, BROADCAST_ROWS = 100, 200_000
MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("5a1c5f43-6c0e-4c6f-9a58-0f2f4d1f7c11")


def record_id(page: int | None, *more: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, ' '.join(map(str, (page, *more))))}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A whole WARC record, response or (with ``refers_to``) revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest) if page is None else record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127))


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records) if len(records) >= 8 else None
    except zstandard.ZstdError:  # too little to learn from
        return None


class Archive:
    """One file: records are held until the sample is full, then the dictionary is built and all are written."""

    def __init__(self, uri: str) -> None:
        self.system, self.path = fs.FileSystem.from_uri(uri)
        self.uri, self.temporary = uri, f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.temporary, compression=None)
        self.sample: list[bytes] | None = []
        self.bytes = self.count = 0

    def _start(self) -> None:
        held, self.sample = self.sample, None
        learnt = dictionary(held)
        if learnt:
            raw = learnt.as_bytes()
            self.out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=learnt, write_checksum=True)
        info = f"software: dictionary-compressed WARC writer\r\nformat: WARC File Format 1.1\r\nrecords-sampled: {len(held)}\r\n".encode()
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, self.path.rpartition('/')[2])}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        for r in (head.encode() + info + b"\r\n\r\n", *held):
            self.out.write(self.compressor.compress(r))

    def add(self, r: bytes) -> None:
        self.bytes += len(r)
        self.count += 1
        if self.sample is None:
            self.out.write(self.compressor.compress(r))
        else:
            self.sample.append(r)
            if self.bytes >= SAMPLE_BYTES:
                self._start()

    def discard(self) -> None:
        """What a failed task leaves goes."""
        self.out.close()
        self.system.delete_file(self.temporary)

    def close(self) -> tuple[str, int, int]:
        if self.sample is not None:
            self._start()
        self.out.close()
        self.system.move(self.temporary, self.path)
        return self.uri, self.count, self.bytes


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id long, url, html) below ``folder``; returns the stored (path, records, bytes) of the archives."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns({"digest": F.sha2(payload, 256), "size": F.length(payload)})
    copies = pages.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    copies = stored(copies.where("n > 1 and least is not null").select("digest", "least"))
    if copies.count() <= BROADCAST_ROWS:
        rows = pages.join(F.broadcast(copies), "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("least"), F.col("least")).alias("refers_to"))
    else:
        # Without the html first: a digest that many pages have is one key, but a page with its digest is not.
        again = stored(pages.select("page_id", "digest").join(copies, "digest").where("page_id <> least").select("page_id", "digest", F.col("least").alias("refers_to")).distinct())
        rows = pages.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, open_ = TaskContext.get().partitionId(), [], None
        try:
            for batch in batches:
                for page, url, html, digest, to in zip(*(batch.column(n) for n in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if open_ is None:
                        open_ = Archive(f"{folder}/part-{task:05d}-{len(made):04d}.warc.zst")
                    open_.add(record(page.as_py(), url.as_py(), as_bytes(html.as_py()), digest.as_py(), to.as_py()))
                    if open_.bytes >= ARCHIVE_BYTES:
                        made.append(open_.close())
                        open_ = None
            if open_:
                made.append(open_.close())
                open_ = None
        finally:
            if open_:
                open_.discard()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "records", "bytes"])

    return stored(rows.mapInArrow(tidy(run), "path string, records long, bytes long"))


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a .warc.zst stream."""
    head = stream.read(8)
    learnt = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == MAGIC:
        learnt = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    reader = zstandard.ZstdDecompressor(dict_data=learnt).stream_reader(_Joined(head, stream), read_across_frames=True)
    text = io.BufferedReader(reader, 1 << 18)
    while version := text.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        headers = {}
        while (line := text.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = text.read(n)
        if len(block) != n or text.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


class _Joined(io.RawIOBase):
    def __init__(self, first: bytes, rest: io.BufferedIOBase) -> None:
        self.first, self.rest = first, rest

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self.first:
            out, self.first = self.first, b""
            return out
        return self.rest.read(n)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of each page's record in the archives (path). A response's digest is computed from the payload that was read and must be the one that the header names; a revisit's are its header's. ``payloads``: with the payload of responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                out: list[tuple] = []
                held = 0
                with system.open_input_stream(inner, compression=None) as stream:
                    for headers, block in records(stream):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"the payload of {headers['warc-record-id']} isn't the one that was written")
                        page, to = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        out.append((page and int(page), headers["warc-target-uri"], size, digest, kind, to and int(to), body if payloads and kind == "response" else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield _batch(out)
                            out, held = [], 0
                yield _batch(out)

    n = max(archives.count(), 1)
    return archives.select("path").repartition(min(n, 100_000)).mapInArrow(tidy(run), READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), shared_folder(spark))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
FROM f
"""
