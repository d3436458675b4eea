"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames followed by a seek table (a
skippable frame that lists the compressed and plain size of every frame), so any
record is read by decompressing one frame.  ``write_archives`` writes bundles below
the shared folder and returns an index that maps each record to its bundle, its
frame and its offset within that frame; ``read_archives`` parses bundles back;
``read_record`` fetches one record through the index.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the
smallest id is the response and the others are revisits that keep only headers.
Null payloads are empty.  Rows that repeat the smallest id with an equal payload are
all responses; rows without an id are revisits if some equal payload has an id, else
responses.  A null URL leaves the target header out.  An empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.llm.common import column, fresh_dir, materialise, record, table

MIN_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.schema(
    [("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_bytes", pa.int32()), ("record_at", pa.int32()), ("record_bytes", pa.int32())]
)
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload: bytes | None  # None in a revisit
    payload_bytes: int
    payload_digest: str


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def format_record(r: Record, date: str = "1970-01-01T00:00:00Z") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + (r.payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {r.record_type}", f"WARC-Record-ID: {_urn(r.page_id)}", f"WARC-Date: {date}"]
    if r.url is not None:
        head.append("WARC-Target-URI: " + r.url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{r.payload_digest}")
    if r.record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(r.refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, Record]]:
    """(offset, size, record) of each record in a plain frame; the digest is taken anew from a stored payload."""
    at = 0
    while at < len(data):
        start, end = at, data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        body, size = end + 4, int(head["Content-Length"])
        at = body + size + 4
        if data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"record at {start} is cut off")
        cut = data.index(b"\r\n\r\n", body) + 4
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
        n = int(next(x for x in data[body:cut].decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        payload = None
        if kind == "response":
            payload = data[cut : body + size]
            if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload at {start} does not match its digest")
        refers = head.get("WARC-Refers-To")
        yield start, at - start, Record(_id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, refers and _id(refers), payload, n, digest)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer of an open bundle."""
    size = f.size() if callable(getattr(f, "size", None)) else f.seek(0, 2)
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * width)
    table, at, out = f.read(n * width), 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


class BundleWriter:
    """Collects records into frames, and frames into one bundle file."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.uri, self.frame_bytes = uri, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.parts: list[bytes] = []
        self.frames: list[tuple[int, int]] = []
        self.rows: list[tuple] = []
        self.open: list[tuple[int | None, bytes]] = []
        self.at = self.plain = self.pending = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.open.append((page_id, data))
        self.pending += len(data)
        self.plain += len(data)
        if self.pending >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.open:
            return
        packed, at = self.packer.compress(b"".join(d for _, d in self.open)), 0
        for page_id, data in self.open:
            self.rows.append((page_id, self.uri, len(self.frames), self.at, len(packed), at, len(data)))
            at += len(data)
        self.frames.append((len(packed), at))
        self.parts.append(packed)
        self.at += len(packed)
        self.open, self.pending = [], 0

    def close(self) -> list[tuple]:
        """Write the file in one go; the index rows of its records."""
        self.flush()
        with self.fs.open_output_stream(self.path, compression=None) as f:
            f.write(b"".join(self.parts))
            f.write(seek_table(self.frames))
        return self.rows


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of every row.

    Digests are grouped with map-side partial aggregation; only groups of two or more go
    into the join, whose large side (the pages) may be split where a payload is frequent.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)}
    )
    same = (
        pages.filter(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("leader"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    return pages.join(same, ["payload_digest", "payload_bytes"], "left").select(
        "page_id",
        "url",
        F.when(revisit, F.lit(None)).otherwise(F.col("html")).alias("html"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("leader")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, out_dir: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the bundles once; the index, one row per record, is itself a written table.

    A file name holds a random part, so a task that runs again leaves only files that
    no index row names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bundle, n = TaskContext.get().partitionId(), None, 0

        def done(w: BundleWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*w.close()), _INDEX)], schema=_INDEX)

        for batch in batches:
            cols = [column(batch, c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, html, size, digest, kind, refers = (c[k].as_py() for c in cols)
                if bundle is None:
                    bundle = BundleWriter(f"{out_dir}/bundle-{part:05d}-{n:04d}-{uuid.uuid4().hex[:8]}.warc.zst", frame_bytes)
                    n += 1
                bundle.add(page_id, format_record(Record(page_id, url, kind, refers, html, size, digest)))
                if bundle.plain >= bundle_bytes:
                    yield done(bundle)
                    bundle = None
        if bundle is not None:
            yield done(bundle)

    where, path = fs.FileSystem.from_uri(out_dir)
    where.create_dir(path)
    index = decide(pages).mapInArrow(run, "page_id long, path string, frame int, frame_at long, frame_bytes int, record_at int, record_bytes int")
    return materialise(index, "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """One row per record, parsed frame by frame from the bundles that the index names."""
    paths = index.select("path").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri in column(batch, "path").to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_file(path) as f:
                    for at, packed, plain in read_seek_table(f):
                        f.seek(at)
                        found = [r for _, _, r in parse_records(unpack.decompress(f.read(packed), max_output_size=plain))]
                        yield record(_READ, **{c: [getattr(r, c) for r in found] for c in _READ.names})

    n = min(max(1, paths.count()), 10_000)
    return paths.repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def read_record(path: str, frame_at: int, frame_bytes: int, record_at: int, record_bytes: int) -> Record:
    """One record by its index row: one seek, one frame."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as f:
        f.seek(frame_at)
        plain = zstandard.ZstdDecompressor().decompress(f.read(frame_bytes))
    return next(parse_records(plain[record_at : record_at + record_bytes]))[2]


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_warc_bundles": op5_warc_bundles}
SQL: dict[str, str] = {
    "op5_warc_bundles": """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(encode(coalesce(html, ''))) AS h FROM pages
), g AS (
  SELECT h, n, min(page_id) AS leader FROM d GROUP BY h, n
)
SELECT d.page_id AS page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN d.n >= 100 AND d.page_id IS DISTINCT FROM g.leader AND g.leader IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.n >= 100 AND d.page_id IS DISTINCT FROM g.leader THEN g.leader END AS refers_to
FROM d JOIN g ON d.h = g.h AND d.n = g.n
"""
}
