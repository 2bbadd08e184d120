"""WARC archives: a writer with revisit records, and a splittable reader.

The writer makes one file per task, one gzip member per record; a finished file is moved into place under a name that
follows from the partition, so a repeated task replaces its own file. The reader cuts files into byte ranges. A task
looks for gzip magic in its range, accepts a candidate when the decoded bytes begin with a WARC header, and owns the
records that start inside its range, reading beyond its end where the last one does. Damaged members are skipped.

Null payloads count as empty, null URLs as ``urn:unknown``. Of rows with equal payloads of ``min_bytes`` or more, those
with the smallest id are responses and the others (also a null id) revisit it; a group of null ids only is all response.
Rows may repeat; each gets its record. An empty table gives no file and no record. A record larger than memory allows
cannot be read; ranges, files and batches are bounded.

UTF-8 text cannot hold the gzip magic. A payload that is itself a gzipped archive, stored without compression, could
make a task that starts inside it take the inner records for outer ones.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import written

MIN_BYTES, RANGE_BYTES, CHUNK = 100, 8 << 20, 1 << 18
MAGIC = b"\x1f\x8b\x08"
RECORD = (
    "file string, offset bigint, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, http_length bigint, payload binary"
)
_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("refers_to", pa.string()), ("payload_digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary()),
])


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, level: int = 6) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {_clean(uri) if uri else 'urn:unknown'}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Digests that several rows share, with the smallest id: page_id of the response by digest."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    d = pages.select("page_id", F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest")).where(F.col("n") >= min_bytes)
    return d.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first_id")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        temp, out, size, n = f"{base}/_{uuid.uuid4().hex}", None, 0, 0
        for b in batches:
            for k, url, html, first in zip(*(b.column(c) for c in ("page_id", "url", "html", "first_id"))):
                out = out or store.open_output_stream(temp)
                i, f = k.as_py(), first.as_py()
                data = member(f"urn:page:{i}", url.as_py(), (html.as_py() or "").encode(), f"urn:page:{f}" if f is not None and f != i else None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            store.move(temp, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write page_id, url, html as archives under ``folder`` (shared by all executors); file, bytes and records of each."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base)
    dups = written(revisits(pages, min_bytes))
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(body) >= min_bytes, F.sha2(body, 256)).alias("digest"))
    rows = rows.join(dups, "digest", "left").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.col("first_id").cast("bigint").alias("first_id"))
    return written(rows.mapInArrow(_write(folder), "file string, bytes bigint, records bigint"))


class _Window:
    """Bytes of a file around a moving place, read in chunks."""

    def __init__(self, f, size: int):
        self.f, self.size, self.base, self.data = f, size, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.base or offset + n > self.base + len(self.data):
            self.base, self.data = offset, self.f.read_at(min(max(n, CHUNK), max(0, self.size - offset)), offset)
        return self.data[offset - self.base:offset - self.base + n]


def _decode(w: _Window, offset: int) -> tuple[bytes, int] | None:
    """Content and end of the member at ``offset``, if it is whole and holds a WARC record."""
    z, out, at, seen = zlib.decompressobj(31), [], offset, b""
    try:
        while not z.eof:
            piece = w.at(at, min(CHUNK, w.size - at))
            if not piece:
                return None
            got = z.decompress(piece)
            at += len(piece)
            out.append(got)
            if len(seen) < 5:
                seen += got[:5]
                if not b"WARC/".startswith(seen[:5]):
                    return None
    except zlib.error:
        return None
    return (b"".join(out), at - len(z.unused_data)) if seen[:5] == b"WARC/" else None


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def _record(name: str, offset: int, data: bytes) -> dict:
    h, rest = _headers(data)
    block = rest[:int(h.get("content-length", len(rest)))]
    http, payload = _headers(block) if block.startswith(b"HTTP/") else ({}, block)
    kind, uri = h.get("warc-type"), h.get("warc-target-uri")
    digest = h.get("warc-payload-digest")
    return {
        "file": name, "offset": offset, "record_id": h.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": uri,
        "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, "payload_digest": digest,
        "http_length": int(http["content-length"]) if http.get("content-length", "").isdigit() else None,
        "payload": None if kind == "revisit" else payload,
    }


def records_in(f, name: str, size: int, start: int, end: int) -> Iterator[dict]:
    """Records whose member starts in bytes ``start`` to ``end`` of an open file."""
    w, at = _Window(f, size), start
    while at < end:
        chunk = w.at(at, min(CHUNK, size - at))
        k = chunk.find(MAGIC)
        if k < 0:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += k
        if at >= end:
            return
        found = _decode(w, at)
        if found is None:
            at += 1
            continue
        yield _record(name, at, found[0])
        at = found[1]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            store, path = pafs.FileSystem.from_uri(row["file"])
            rows, held = [], 0
            with store.open_input_file(path) as f:
                for r in records_in(f, row["file"], row["bytes"], row["start"], row["end"]):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if held > CHUNK * 16 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """file and bytes of the archives under a folder; contents are not read here."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return f.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives listed in ``files`` (file, bytes), by byte ranges of ``range_bytes``."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    r = files.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    r = r.select("file", "bytes", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    n = max(1, files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1)
    return r.repartition(int(min(n, 100_000)), "file", "start").mapInArrow(_read, RECORD)
