"""Operator 3: WARC archives through a chunked record table.

Archives are read as rows (record id, chunk number) of bounded size: reading carries the byte count and the digest from
chunk to chunk and holds a chunk at a time, and the last chunk of a record has its totals. Writing compresses chunk by
chunk, but takes each payload from a table's row, which Spark holds whole. Of records with equal payloads, one is
written as a response and the others as revisits. The headers Page-ID and Refers-To-Page-ID tie records to pages.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import lookup, materialize, new_path, small_batches

CHUNK_BYTES = 1 << 20
#: Level of the gzip members, one a record.
GZIP_LEVEL = 3
CHUNKS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, data binary, "
    "bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"
)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(path: str, number: int) -> str:
    """The id of a record, unique by its file (whose name no other task attempt has) and its number there."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{number}')}>"


def _digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload (UTF-8), payload_bytes, payload_sha1, record_type, refers_to and refers_to_url to pages (page_id, url, html).

    Equal payloads meet by digest only; the digest that most pages share is spread (see common.lookup). Among pages
    with equal payloads of at least least_bytes the smallest page_id is the response (repeated rows of it too; a null
    page_id only where all are null).
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_sha1").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.where("_n > 1 and _first is not null")
    rows = lookup(rows, first, "payload_sha1", "_n", F.struct("page_id", "url"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    named = {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_first.page_id")), "refers_to_url": F.when(revisit, F.col("_first.url"))}
    return rows.withColumns(named).drop("_first")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(planned: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write planned records as gzipped WARC 1.1 files into folder (a URI all executors reach): (path, records, bytes).

    Every attempt of a task writes a file of its own; only files in the returned manifest count, so lost executors and
    repeated tasks do no harm. Partitions without rows write none.
    """

    def header(kind: str, fields: list[tuple[str, str]], length: int) -> bytes:
        lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"WARC-Date: {date}", f"Content-Length: {length}"]
        return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")

    def member(out, parts: Iterator) -> None:
        z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        for p in parts:
            out.write(z.compress(p))
        out.write(z.flush())

    def run(batches):
        ctx, out, n, path = TaskContext.get(), None, 0, ""
        for batch in batches:
            ids, urls, payloads, sizes, sha, kinds, refers, refers_url = (batch.column(i) for i in range(8))
            for i in range(batch.num_rows):
                if out is None:
                    path = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    store, local = _open(path)
                    store.create_dir(local.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(local, compression=None)
                    info = b"software: tablesmith\r\nformat: WARC File Format 1.1\r\n"
                    member(out, [header("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"), ("Content-Type", "application/warc-fields")], len(info)), info, b"\r\n\r\n"])
                page, kind, size = ids[i].as_py(), kinds[i].as_py(), sizes[i].as_py()
                digest = base64.b32encode(bytes.fromhex(sha[i].as_py())).decode()
                url = " ".join((urls[i].as_py() or "").split())
                fields = [("WARC-Record-ID", record_id(path, n)), *([("Page-ID", str(page))] if page is not None else []), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                if kind == "revisit":
                    fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To-Target-URI", " ".join((refers_url[i].as_py() or "").split())), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", str(refers[i].as_py()))]
                    member(out, [header(kind, fields, len(http)), http, b"\r\n\r\n"])
                else:
                    data = payloads[i].as_buffer()
                    chunks = (data[a : a + chunk_bytes] for a in range(0, size, chunk_bytes))
                    member(out, (p for part in ([header(kind, fields, len(http) + size), http], chunks, [b"\r\n\r\n"]) for p in part))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    small_batches(planned.sparkSession)
    chosen = planned.select("page_id", "url", "payload", "payload_bytes", "payload_sha1", "record_type", "refers_to", "refers_to_url")
    return materialize(chosen.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class _Members(io.RawIOBase):
    """The inflated bytes of a file of gzip members, read in bounded pieces."""

    def __init__(self, source, piece: int = 1 << 18):
        self.source, self.piece, self.z, self.rest = source, piece, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.rest:
                self.rest = bytes(self.source.read(self.piece))
                if not self.rest:
                    return 0
            got = self.z.decompress(self.rest, len(out))
            self.rest = self.z.unconsumed_tail if not self.z.eof else b""
            if got:
                out[: len(got)] = got
                return len(got)


def _line(stream: io.BufferedReader) -> bytes:
    line = stream.readline()
    if not line.endswith(b"\n"):
        raise ValueError("a WARC file ends within a record")
    return line.rstrip(b"\r\n")


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    found = {}
    while line := _line(stream):
        k, _, v = line.decode("utf-8").partition(":")
        found[k.strip().lower()] = v.strip()
    return found


def read_records(stream: io.BufferedReader, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of CHUNKS from the inflated bytes of an archive; a record without payload bytes has one chunk, of no bytes.

    Raises ValueError where a response's payload doesn't have the digest that its header gives.
    """
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = _fields(stream)
        left, kind = int(head["content-length"]), head["warc-type"]
        if kind == "warcinfo":
            stream.read(left)
            continue
        said, before = head["warc-payload-digest"].removeprefix("sha1:"), left
        status = _line(stream)
        http = len(status) + 2
        total = 0
        while line := _line(stream):
            http += len(line) + 2
            if line.lower().startswith(b"content-length:"):
                total = int(line.partition(b":")[2])
        left = before - http - 2
        page, refers = (int(head[k]) if k in head else None for k in ("page-id", "refers-to-page-id"))
        base = (head["warc-record-id"], page, head.get("warc-target-uri"), kind, refers)
        sha, done, k = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left - done))
            if len(data) < min(chunk_bytes, left - done):
                raise ValueError("a WARC file ends within a record")
            sha.update(data)
            done += len(data)
            last = done == left
            if last and kind != "revisit" and (_digest(sha) != said or done != total):
                raise ValueError(f"the payload of {base[0]} is not what its header says")
            yield (*base, k, data, done, _digest(sha), last, total if last else None, said if last else None)
            k += 1
            if last:
                break


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest (path, ...), in whatever order of records.

    Rows of a record: chunk_no from 0, data, the bytes and SHA-1 of the payload up to the chunk's end, and on the last
    chunk the totals of the full payload (of a revisit: those of the response it refers to). Digests are base32.
    with_data false leaves data null, for callers that need the totals only. Digests are checked against the headers.
    """
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = _open(path)
                rows, size = [], 0
                with contextlib.closing(store.open_input_stream(local, compression=None)) as source:
                    for r in read_records(io.BufferedReader(_Members(source), 1 << 18), chunk_bytes):
                        rows.append(r if with_data else (*r[:6], None, *r[7:]))
                        size += len(r[6]) if with_data else 100
                        if size >= 4 * chunk_bytes or len(rows) >= 4096:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    files = manifest.select("path")
    n = max(1, min(manifest.count(), 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(n).mapInArrow(run, CHUNKS)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write one record per page (page_id, url, html) and return the manifest of the archives.

    Null html is an empty payload, null url an empty target, repeated rows are written each; no pages: no archives.
    """
    return write_archives(plan_records(pages, least_bytes), folder or new_path(pages.sparkSession, "warc"), chunk_bytes)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive the pages and read the archives back: per page the totals of its record.

    A response's size is that of all its chunks in the record table and its digest the last chunk's, carried on from
    the first; a revisit, which has no payload, has those of the response it refers to.
    """
    chunks = read_archives(archive(pages, None, least_bytes))
    own = lambda c: F.max(F.when(F.col("last"), F.col(c))).alias(c)
    sums = chunks.groupBy("record_id").agg(F.sum(F.octet_length("data")).alias("read"), *[own(c) for c in ("page_id", "payload_bytes", "payload_digest", "digest_so_far", "record_type", "refers_to")])
    response = F.col("record_type") == "response"
    return sums.select("page_id", F.when(response, F.col("read")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"), F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
