"""Operator 1, WARC archives as seekable Zstandard bundles.

Records are grouped into independent zstd frames; a bundle ends with a seek table
(a skippable frame with each frame's compressed and plain size), so any frame is
read alone. The index maps record ids to bundle, frame and the record's place in
the plain frame. Of records with equal payloads of at least `min_revisit_bytes`,
that with the largest page id is the response; the others are revisits that refer
to it and carry no payload.

A task writes bundles under names of its own and returns their index rows; the
index is written as a table, and only bundles it names are ever read. So a task
that is run again, or twice, leaves nothing wrong behind. Bundles are written and
read through pyarrow.fs in the shared folder.

Edge cases: null payload is empty; a null page id is written as an empty field and
read back as null; rows with one page id and one payload are all responses, or all
revisits, and such responses, being one record written twice, share their record id
(revisits never do); the largest page id has no ties but these; a very long payload is a
frame of its own; an empty table makes no bundle; url may be null and is escaped; only
the id, the url and the payload are read, so no other column can clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import Workspace

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}'.encode() + digest).digest())}"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[str, bytes]:
    """(record id, the record's bytes)."""
    own = f"urn:uuid:{uuid.uuid4()}" if revisit else record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}", f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(headers, payload length, payload or nothing for a revisit) of each record; a broken record is a ValueError."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        first, *lines = plain[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("no WARC record where one should start")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        n = int(headers["Content-Length"])
        block = plain[end + 4 : end + 4 + n]
        at = end + 4 + n + 4
        if plain[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
        yield headers, size, payload


class BundleWriter:
    """One bundle: frames of about frame_bytes, then the seek table."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, level: int):
        self.path, self.out, self.zip = path, fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.size = 0

    def frame(self, plain: bytes) -> int:
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.size += len(packed)
        return len(self.frames) - 1

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the end of the file."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table at the end of the bundle")
    f.seek(size - 9 - 8 * n)
    raw = f.read(8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(f: pa.NativeFile, offset: int, packed: int, plain: int) -> bytes:
    f.seek(offset)
    data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    if len(data) != plain:
        raise ValueError("a frame has another size than its seek table says")
    return data


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 256 << 20, level: int = 3, date: str | None = None) -> DataFrame:
    """Writes a record for each row and returns the index. date: of all records; now, if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    ws = Workspace(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    # a payload's largest id is summed before it is moved; read from a table, it has an exchange of its own, so Spark can split a payload with very many rows
    groups = ws.write(rows.where(F.length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep"), "groups")
    root = ws.path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(root)
        fs.create_dir(f"{base}/bundles", recursive=True)
        bundle: BundleWriter | None = None
        held: list[tuple[str, int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal bundle, held, size
            if bundle is None:
                bundle = BundleWriter(fs, f"{base}/bundles/{uuid.uuid4().hex}.warc.zst", level)
            frame = bundle.frame(b"".join(x[2] for x in held))
            at, out = 0, []
            for own, page, data in held:
                out.append((own, page, bundle.path.rsplit("/", 1)[1], frame, at, len(data)))
                at += len(data)
            if bundle.size >= bundle_bytes:
                bundle.close()
                bundle = None
            held, size = [], 0
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["record_id", "page_id", "bundle", "frame", "offset", "length"])

        for b in common.slices(batches, "payload"):
            for page, url, data, digest, keep, grouped in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "keep", "grouped")), strict=True):
                own, record = make_record(page, url, data, digest, keep, bool(grouped) and keep is not None and page != keep, date)
                held.append((own, page, record))
                size += len(record)
                if size >= frame_bytes:
                    yield flush()
        if held:
            yield flush()
        if bundle:
            bundle.close()

    marked = rows.join(groups.withColumn("grouped", F.lit(True)), "digest", "left")
    return ws.write(marked.select("page_id", "url", "payload", "digest", "keep", "grouped").mapInArrow(write, INDEX), "index").withColumn("root", F.lit(root))


RECORDS = "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_archives(index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """All records of the bundles that the index names; payload is null for revisits, and for all if not payloads. Each response's digest is checked; a revisit has no payload to check its by."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for root, name in zip(b.column("root").to_pylist(), b.column("bundle").to_pylist(), strict=True):
                fs, base = pa.fs.FileSystem.from_uri(root)
                with fs.open_input_file(f"{base}/bundles/{name}") as f:
                    out += [(root, name, *x) for x in seek_table(f)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["root", "bundle", "at", "packed", "plain"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, name, at, packed, plain in zip(*(b.column(c).to_pylist() for c in ("root", "bundle", "at", "packed", "plain")), strict=True):
                fs, base = pa.fs.FileSystem.from_uri(root)
                with fs.open_input_file(f"{base}/bundles/{name}") as f:
                    data = read_frame(f, at, packed, plain)
                out = []
                for h, size, payload in parse_records(data):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = h["WARC-Type"] == "response"
                    if response and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload is not what was written")
                    refers = h.get("X-Refers-To-Page-ID")
                    out.append((int(h["X-Page-ID"]) if h["X-Page-ID"] else None, h["WARC-Record-ID"].strip("<>"), size, digest, h["WARC-Type"], int(refers) if refers else None, h["WARC-Target-URI"], payload if payloads and response else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    frames = index.select("root", "bundle").distinct().mapInArrow(tables, "root string, bundle string, at long, packed long, plain long")
    return frames.repartition(parts, "bundle", "at").mapInArrow(read, RECORDS)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(record_id, record) of the wanted ids: only their frames are read, and cut by the frame-relative offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own, root, name, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("record_id", "root", "bundle", "frame", "offset", "length")), strict=True):
                fs, base = pa.fs.FileSystem.from_uri(root)
                with fs.open_input_file(f"{base}/bundles/{name}") as f:
                    out.append((own, read_frame(f, *seek_table(f)[frame])[offset : offset + length]))
            cols = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], names=["record_id", "record"])

    return index.join(ids.select("record_id").distinct(), "record_id").mapInArrow(read, "record_id string, record binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(common.table(spark, sf_dir, "pages"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS keep FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, ((i // 4) * 5 + 1)::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k
"""
}
