"""Seekable Zstandard WARC bundles (operator 4).

A bundle is a file of independent Zstandard frames, each holding a group of
WARC records, and a footer: a skippable frame with the Zstandard seek table
(compressed and decompressed size of every frame), so a reader finds a frame
without scanning.  An index maps each record identifier to its bundle, frame
and offset within the decompressed frame.

Tasks write their own bundles through Arrow's file systems to the shared
folder.  Every attempt has file names of its own, and only files named in the
index count: the index is cut to the checkpoint folder once, so bundles are
not written again and a lost or repeated attempt leaves at most a file that
nobody reads.

Records with equal payloads (compared by SHA-1 and length): those with the
largest ``page_id`` are responses, the others revisit records that refer to
it.  Each record carries its payload digest and length; a revisit keeps its
payload out of the file, and reading resolves what it refers to by the index.

Defined cases: a null payload is empty, and empty payloads are equal ones; a
row with a null ``page_id`` is a response that nothing refers to; rows that
repeat a ``page_id`` and payload are each a record of the same type; an empty
table gives no record; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import chunks, column_bytes, cut, table, to_batch
from parcela.session import ensure_checkpoint_dir

#: Fixed values of the seekable format: the skippable frame's magic, and the seek table's.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
                   ("frame_start", pa.int64()), ("frame_size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = ("record_id string, page_id long, bundle string, frame int, frame_start long, frame_size long, "
             "offset long, length long")
READ = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                  ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("payload", pa.binary())])
READ_DDL = ("record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
            "payload_digest string, payload binary")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("X-Refers-To-Page-ID", str(refers_to))]
    body = payload if refers_to is None else b""
    head.append(("Content-Length", str(len(body))))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


class BundleWriter:
    """Collects records into frames of about ``frame_bytes`` and writes one bundle."""

    def __init__(self, sink: pa.NativeFile, frame_bytes: int, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.press = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.at = 0
        self.open: list[bytes] = []
        self.size = 0
        self.waiting: list[tuple] = []

    def add(self, key: tuple, record: bytes) -> Iterator[tuple]:
        """Yields (key, frame, frame start, frame size, offset, length) of records whose frame is written."""
        self.waiting.append((key, self.size, len(record)))
        self.open.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            yield from self.end_frame()

    def end_frame(self) -> Iterator[tuple]:
        if self.open:
            frame = self.press.compress(b"".join(self.open))
            self.sink.write(frame)
            yield from ((k, len(self.frames), self.at, len(frame), o, n) for k, o, n in self.waiting)
            self.frames.append((len(frame), self.size))
            self.at += len(frame)
            self.open, self.waiting, self.size = [], [], 0

    def close(self) -> None:
        """Appends the seek table: entries, then frame count, descriptor and magic."""
        entries = b"".join(struct.pack("<II", a, b) for a, b in self.frames)
        body = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.sink.close()


def read_seek_table(source: pa.NativeFile) -> list[tuple[int, int]]:
    """(start, compressed size) of a bundle's frames, from its footer alone."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", source.read(8 * n))[::2]
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s)
    return list(zip(starts, sizes))


def read_record(uri: str, frame: int, offset: int, length: int) -> bytes:
    """One record of a bundle: footer, one frame, one slice."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        start, size = read_seek_table(f)[frame]
        f.seek(start)
        return zstandard.ZstdDecompressor().decompressobj().decompress(f.read(size))[offset:offset + length]


def _uri(path: str) -> str:
    return path if re.match(r"[a-z0-9+.-]+:", path) else f"file://{path}"


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Writes every row (page_id, url, html) as a record under ``folder`` and returns the index.

    ``frame_bytes`` and ``bundle_bytes`` count records before compression; a
    record over ``frame_bytes`` has a frame to itself.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8"))).withColumn("n", F.octet_length("html"))
    # Only payloads that repeat can have revisits; a hot payload is reduced before the shuffle.
    repeated = (rows.where("page_id IS NOT NULL").groupBy("sha1", "n")
                .agg(F.max("page_id").alias("best"), F.min("page_id").alias("_least")).where("best > _least")
                .select("sha1", "n", "best"))
    placed = rows.join(repeated.hint("shuffle_hash"), ["sha1", "n"], "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") < F.col("best"), F.col("best")).alias("refers_to"))
    base = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        writer, name, held = None, "", []

        def located(found: Iterator[tuple]) -> list[tuple]:
            return [(r, p, f"{base}/{name}", k, a, z, o, n) for (r, p), k, a, z, o, n in found]

        for batch in batches:
            for part in chunks(batch, "html"):
                for page, url, html, ref in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(),
                                                column_bytes(part.column("html")), part.column("refers_to").to_pylist()):
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                    record_id = f"urn:uuid:{uuid.uuid4()}"
                    held += located(writer.add((record_id, page), warc_record(record_id, page, url, html, ref)))
                    if writer.at >= bundle_bytes // 4:
                        held += located(writer.end_frame())
                        writer.close()
                        writer = None
                yield to_batch(held, INDEX)
                held = []
        if writer is not None:
            held += located(writer.end_frame())
            writer.close()
        yield to_batch(held, INDEX)

    return cut(placed.mapInArrow(run, INDEX_DDL))


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records an index names, read frame by frame; digest and length of a
    response are taken from its payload as read, not from its headers.

    Each frame is fetched once: index rows meet by frame.  A revisit's payload
    is left null (see ``resolve``); with ``payloads`` false all are.
    """
    frames = index.groupBy("bundle", "frame", "frame_start", "frame_size").agg(
        F.collect_list(F.struct("offset", "length")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, _, start, size, spans in zip(*(batch.column(i).to_pylist() for i in range(5))):
                fs, path = pafs.FileSystem.from_uri(bundle)
                with fs.open_input_file(path) as f:
                    f.seek(start)
                    data = unpress.decompressobj().decompress(f.read(size))
                out = []
                for s in spans:
                    head, block = parse_record(data[s["offset"]:s["offset"] + s["length"]])
                    revisit = head["WARC-Type"] == "revisit"
                    page = head.get("X-Page-ID")
                    out.append((head["WARC-Record-ID"][1:-1], None if page is None else int(page), head["WARC-Target-URI"],
                                head["WARC-Type"], int(head["X-Refers-To-Page-ID"]) if revisit else None,
                                int(head["X-Payload-Length"]) if revisit else len(block),
                                head["WARC-Payload-Digest"][5:] if revisit else digest(block),
                                block if payloads and not revisit else None))
                yield to_batch(out, READ)

    return frames.mapInArrow(run, READ_DDL)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the payload of every revisit taken from the response it refers to."""
    named = (records.where("record_type = 'response' AND page_id IS NOT NULL")
             .groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest"))
             .agg(F.first("payload").alias("_shared")))
    return (records.join(named, ["refers_to", "payload_digest"], "left")
            .withColumn("payload", F.coalesce("payload", "_shared")).drop("_shared"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to bundles, reads these back: one row a page."""
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_bundles(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT h, max(page_id) AS best FROM p WHERE page_id IS NOT NULL GROUP BY h
), codes AS (
  SELECT p.page_id, p.html, g.best,
         list_transform(range(8), lambda i: CAST('0x' || substr(p.h, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS v
  FROM p LEFT JOIN g ON p.h = g.h
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       list_aggregate(list_transform(v, lambda x:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < best THEN best END AS refers_to
FROM codes
"""
