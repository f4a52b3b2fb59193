"""Operator 7: WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records of
about `frame_bytes`, and a skippable frame at the end with the seek table of the
seekable format (per frame its compressed and decompressed size, then the number of
frames, a descriptor byte and the magic number). The index maps record identifiers to
(bundle, frame, offset in the frame's content, length), so one record costs one frame.

Of records with equal payloads of at least `revisit_bytes`, the one with the largest
page_id is a response, the others are revisits that refer to it; smaller payloads are
all responses. The payload digest is the bare upper-case base32 SHA-1.

A record's identifier is page:<page_id>; rows that share a page_id, and rows without one,
have their bundle and place in it added or instead, so that every identifier is unique. A
revisit names its response's page in X-Refers-To-Page, and in WARC-Refers-To the record,
unless several rows share that page_id: then the page alone is known before bundles are
written, and the header, which is optional, is left out.

Null html: an empty payload. Null url: no target header. Line breaks in a url are
percent-encoded. Null page_id: written, and the response only if no equal payload has an
id. Repeated rows: each is written; those that share the largest page_id are all
responses. An empty table gives no bundles and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.common import make_dir, open_fs, scratch, slices, table

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, bundle int, frame int, offset long, length long"


def _headers(fields: list[tuple[str, str | None]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def make_record(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, vague: bool = False) -> bytes:
    """One WARC record; a revisit holds no payload, but its digest and length. vague: several records have the page_id it refers to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = payload if refers_to is None else b""
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:quill:{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if refers_to is None or vague else f"<urn:quill:page:{refers_to}>"),
        ("X-Refers-To-Page", None if refers_to is None else str(refers_to)),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    return _headers(fields) + block + b"\r\n\r\n"


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of each record in a frame's content."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        n = int(headers["Content-Length"])
        yield headers, content[end + 4 : end + 4 + n], at, end + 4 + n + 4 - at
        at = end + 4 + n + 4


class BundleWriter:
    def __init__(self, sink, frame_bytes: int, level: int):
        self.sink, self.frame_bytes, self.compressor = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.waiting, self.frames = bytearray(), []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record. A frame is closed before a record that would make it too large."""
        if self.waiting and len(self.waiting) + len(record) > self.frame_bytes:
            self._close_frame()
        at = len(self.frames), len(self.waiting)
        self.waiting += record
        return at

    def _close_frame(self) -> None:
        packed = self.compressor.compress(bytes(self.waiting))
        self.sink.write(packed)
        self.frames.append((len(packed), len(self.waiting)))
        self.waiting.clear()

    def close(self) -> None:
        if self.waiting:
            self._close_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class BundleReader:
    """Random access by frame through the seek table at the end of the file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        entries = source.read_at(n * width, size - 9 - n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", entries, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def with_revisits(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, shared (other rows have this page_id) and vague (several rows have the page_id it refers to). Only ids and digests are grouped; the payloads are dealt once, by page_id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    keys = rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
    groups = keys.filter(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("rows")).filter("rows > 1 and response is not null").drop("rows")
    repeated = keys.groupBy("page_id").agg(F.count("*").alias("rows")).filter("rows > 1 and page_id is not null").select("page_id", F.lit(True).alias("shared"))
    groups = groups.join(repeated.select(F.col("page_id").alias("response"), F.col("shared").alias("vague")), "response", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    notes = keys.join(groups, "digest", "left").join(repeated, "page_id", "left").select("page_id", "digest", refers.alias("refers_to"), F.coalesce("shared", F.lit(False)).alias("shared"), F.coalesce("vague", F.lit(False)).alias("vague"))
    notes = notes.filter("refers_to is not null or shared").distinct()
    # Rows meet by one number, the page_id or, where it is null, the digest's hash.
    deal = F.coalesce("page_id", F.xxhash64("digest"))
    notes = notes.select(deal.alias("r_deal"), F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to", "shared", "vague")
    same = (F.col("deal") == F.col("r_deal")) & F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    joined = rows.withColumn("deal", deal).join(notes, same, "left")
    return joined.select("page_id", "url", "payload", "refers_to", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("shared", "vague")])


def write_warc_bundles(pages: DataFrame, path: str, revisit_bytes: int = 0, frame_bytes: int = 1 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a bundle for each partition of (page_id, url, html) under `path`; returns the index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = open_fs(f"{path}/bundles")
        fs.create_dir(root, recursive=True)
        name, n = f"bundle-{part:06d}.warc.zst", 0
        with fs.open_output_stream(f"{root}/.{name}.{attempt}") as sink:
            out = BundleWriter(sink, frame_bytes, level)
            for batch in slices(batches, 256):
                rows = []
                for page_id, url, payload, refers_to, shared, vague in zip(*(c.to_pylist() for c in batch.columns)):
                    record_id = f"row:{part}:{n}" if page_id is None else f"page:{page_id}:row:{part}:{n}" if shared else f"page:{page_id}"
                    record = make_record(record_id, page_id, url, payload, refers_to, date, vague)
                    rows.append((page_id, record_id, part, *out.add(record), len(record)))
                    n += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], [f.split()[0] for f in INDEX.split(", ")])
            out.close()
        fs.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")

    make_dir(pages.sparkSession, f"{path}/bundles")
    with_revisits(pages, revisit_bytes).mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def read_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles in a folder, from its headers; the digest of a response is taken of its block and must agree. A task reads one bundle."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "bundle-*.warc.zst").load(folder).select(F.substring_index("path", "/", -1).alias("name"))
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as source:
                    bundle = BundleReader(source)
                    for k in range(len(bundle.frames)):
                        rows = []
                        for h, block, _, _ in parse_records(bundle.frame(k)):
                            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                            if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                                raise ValueError(f"{name}: the payload of {h['WARC-Record-ID']} is damaged")
                            refers = h.get("X-Refers-To-Page")
                            rows.append((int(h["X-Page-ID"]) if "X-Page-ID" in h else None, int(h["X-Payload-Length"]), digest, h["WARC-Type"], int(refers) if refers else None, h.get("WARC-Target-URI")))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])

    dealt = files.repartitionByRange(n, "name")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def op7_warc_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc_bundles(table(spark, sf_dir, "pages"), path)
    return read_warc_bundles(spark, f"{path}/bundles").drop("target_uri")


OP7_SQL = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS h FROM pages
), grouped AS (
    SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS response FROM payloads
), digits AS (
    SELECT *, list_transform(range(0, 32), lambda i: (CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) AS d FROM grouped
)
SELECT page_id, payload_bytes, array_to_string(list_transform(d, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM digits
"""
