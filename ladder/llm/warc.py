"""WARC writing and sequential reading (operator 7).

Every record is a gzip member of its own. Tasks write archives under the shared folder, under names of their own
attempt; a table of the archives of the attempts that ended well (the manifest) says which count, so a retried task
leaves no doubled records. The reader streams an archive: incremental decompression member by member, framing by
content length, digests verified; one record is in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladder.llm.common import Scratch, ship

CHUNK = 1 << 16
ROLL_BYTES = 1 << 28
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, response_id=None, date: str = DATE, level: int = 6) -> bytes:
    """One record as a gzip member: a response, or with ``response_id`` a revisit of that page's response (its
    block has the HTTP head only; the head's Content-Length is the full payload's)."""
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head + payload if response_id is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response_id is None else 'revisit'}",
             f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if response_id is not None:
        lines += [f"WARC-Refers-To: {_name(response_id)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
              f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    parts = [packed.compress("\r\n".join(lines).encode() + b"\r\n\r\n"), packed.compress(block),
             packed.compress(b"\r\n\r\n"), packed.flush()]
    return b"".join(parts)


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>"


def _page(name: str | None) -> str | None:
    return unquote(name[len("<urn:page:"):-1]) or None if name else None


@dataclass
class Record:
    """A record being read: ``feed`` takes its decompressed bytes, ``close`` verifies it."""

    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self._head, self._left, self._tail, self._http = b"", None, b"", b""
        self._block, self._in_payload, self._payload = hashlib.sha1(), False, []

    def feed(self, data: bytes) -> None:
        if self._left is None:
            self._head += data
            end = self._head.find(b"\r\n\r\n")
            if end < 0:
                return
            first, *lines = self._head[:end].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record: {first[:40]!r}")
            self.headers = _fields(lines)
            self._left = int(self.headers["content-length"])
            data, self._head = self._head[end + 4:], b""
        inside, after = data[:self._left], data[self._left:]
        self._left -= len(inside)
        self._tail += after
        self._block.update(inside)
        if self._in_payload:
            self._payload.append(inside)
        elif inside:
            self._http += inside
            end = self._http.find(b"\r\n\r\n")
            if end >= 0:
                self.http = _fields(self._http[:end].decode().split("\r\n")[1:])
                self._in_payload = True
                self._payload.append(self._http[end + 4:])

    def close(self) -> Record:
        if self._left != 0 or self._tail != b"\r\n\r\n":
            raise ValueError("a record's length isn't its Content-Length")
        if self.headers["warc-block-digest"] != "sha1:" + base64.b32encode(self._block.digest()).decode():
            raise ValueError(f"block digest of {self.headers['warc-record-id']}")
        self.payload = b"".join(self._payload)
        if self.kind == "response" and self.headers["warc-payload-digest"] != "sha1:" + base32_sha1(self.payload):
            raise ValueError(f"payload digest of {self.headers['warc-record-id']}")
        return self

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def payload_bytes(self) -> int:
        return len(self.payload) if self.kind == "response" else int(self.http["content-length"])

    @property
    def payload_digest(self) -> str:
        return self.headers["warc-payload-digest"].removeprefix("sha1:")


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(stream, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive, read once from start to end."""
    data = stream.read(chunk)
    while data:
        member, now = zlib.decompressobj(31), Record()
        while not member.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
            now.feed(member.decompress(data))
            data = member.unused_data if member.eof else b""
        yield now.close()
        data = data or stream.read(chunk)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_responses(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, response_id): ``response_id`` is null for pages that are responses. Of equal payloads
    of at least ``least_bytes`` that of the smallest page_id is; rows that repeat this page_id are too. A payload
    that only pages without id have is a response each time."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    digest = F.sha1("payload").alias("d")
    shared = (rows.where(F.length("payload") >= least_bytes).select("page_id", digest)
              .groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    shared = Scratch(pages.sparkSession, "warc").table(shared)  # its size is known to the join
    joined = rows.withColumn("d", F.when(F.length("payload") >= least_bytes, F.sha1("payload"))).join(shared, "d", "left")
    own = F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(~own, F.col("first")).alias("response_id"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, date: str = DATE, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes one record per row into archives in ``folder`` and returns (archive, n_records, n_bytes) of each."""
    ship(pages.sparkSession)

    def run(batches):
        out, path, n, size, store, done = None, None, 0, 0, None, []
        for b in batches:
            for p, u, t, r in zip(*b.columns, strict=True):
                if out is None:
                    store, root = _files(folder)
                    store.create_dir(root, recursive=True)
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)  # records are packed already
                data = record(p.as_py(), u.as_py(), t.as_py(), r.as_py(), date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        cols = list(zip(*done, strict=True)) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()),
                                                                       strict=True)],
                                         names=["archive", "n_records", "n_bytes"])

    rows = with_responses(pages, page_id, url, html, least_bytes)
    return rows.mapInArrow(run, "archive string, n_records long, n_bytes long")


def read_archives(archives: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """One row per record of the archives listed: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (null for revisits). A damaged archive or a wrong digest fails the job."""
    ship(archives.sparkSession)
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=names)

    def run(batches):
        for b in batches:
            for path in b.column(0):
                store, root = _files(folder)
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{path.as_py()}", compression=None) as stream:
                    for r in records(stream):
                        body = r.payload if r.kind == "response" else None
                        rows.append((_page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"),
                                     r.payload_bytes, r.payload_digest, r.kind, _page(r.headers.get("warc-refers-to")),
                                     body))
                        size += len(body or b"")
                        if size > 1 << 23 or len(rows) == 4096:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    tasks = max(1, archives.count())
    got = archives.select("archive").repartition(tasks).mapInArrow(
        run, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers string, "
             "payload binary")
    return got.select(F.col("page").cast(id_type).alias("page_id"), "url", "payload_bytes", "payload_digest",
                      "record_type", F.col("refers").cast(id_type).alias("refers_to"), "payload")


def write_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0) -> DataFrame:
    """All pages written to archives in the shared folder and read back (see ``read_archives``).

    A null payload is empty. Null urls have no target URI. A null page_id gives a record without a name and reads
    back as null. Repeated rows give repeated records. Other columns are not read; no rows give no archives.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/archives"
    listed = scratch.table(write_archives(pages, folder, page_id, url, html, least_bytes))
    return read_archives(listed, folder, pages.schema[page_id].dataType.simpleString())
