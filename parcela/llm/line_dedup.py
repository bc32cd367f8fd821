"""Line dedup: range-partitioned line hashes, streamed in order (operator 1).

Every long enough line becomes (hash of its key, document, position).  The
rows are range-partitioned by hash and document and sorted within their
partition by hash, document (largest first) and position, so a line's first
occurrence in that order is the one that stays.  A pass over the sorted rows
holds a few rows of one line at a time.  A line that is found in very many
documents spreads over several partitions: each reports its document count
and largest document for its first and last line, and these reports (two a
partition) settle what a partition cannot decide alone.  What leaves the pass
are positions to drop, which become one compressed keep bitmap a document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased; keys are compared by 128-bit hash.

Defined cases: a null or empty text is one empty line; rows with a null
``doc_id`` count for no line and keep all of theirs; rows that repeat a
``doc_id`` are one document when documents are counted, and each row keeps or
loses its own lines; an empty table gives an empty result; columns other than
``doc_id``, ``text`` and those named in ``carry`` are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import chunks, column_bytes, cut, table, to_batch

MIN_CHARS = 40
MIN_DOCS = 5
WS = b" \t\n\v\f\r"

LINES = pa.schema([("h0", pa.int64()), ("h1", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()),
                   ("n_lines", pa.int32()), ("pos", pa.int32())])
LINES_DDL = "h0 long, h1 long, doc_id long, version long, n_lines int, pos int"
FOUND = pa.schema([("kind", pa.int8()), *LINES, ("n_docs", pa.int64())])
FOUND_DDL = f"kind tinyint, {LINES_DDL}, n_docs long"
DROP, OPEN, REPORT = 0, 1, 2


def line_keys(data: bytes, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """(position, key) of the lines of a text whose keys have enough code points."""
    for pos, line in enumerate(data.lower().split(b"\n")):
        key = line.strip(WS)
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            yield pos, key


def _documents(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("__version"), *carry)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line whose key is long enough; ``version`` tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows, keys, many = [], [], []
                ids, versions = part.column("doc_id").to_pylist(), part.column("__version").to_pylist()
                for d, v, t in zip(ids, versions, column_bytes(part.column("text"))):
                    n = t.count(b"\n") + 1
                    for pos, key in line_keys(t, min_chars):
                        keys.append(xxhash.xxh3_128_digest(key))
                        rows.append((d, v, n, pos))
                h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                many = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), *(pa.array(c, f.type) for c, f in zip(many, list(LINES)[2:]))], schema=LINES)

    return _documents(docs).where("doc_id IS NOT NULL").mapInArrow(run, LINES_DDL)


def stream(rows: Iterable[tuple], min_docs: int) -> Iterator[tuple]:
    """One pass over a partition's rows, sorted by hash and falling document.

    Yields positions to drop as soon as a line is known to lie in enough
    documents.  For the first and the last line, which other partitions may
    hold too, it also yields what stayed, marked open, and a report.
    """
    key, first_run = None, True
    n_docs, last_doc, best = 0, None, None
    waiting: list[tuple] = []

    def close(open_run: bool) -> Iterator[tuple]:
        if open_run:
            for r in waiting:
                yield (OPEN, *r, None)
            yield (REPORT, *key, best, None, None, None, n_docs)

    for row in rows:
        if (row[0], row[1]) != key:
            if key is not None:
                yield from close(first_run)
                first_run = False
            key, n_docs, last_doc, best, waiting = (row[0], row[1]), 0, None, row[2], []
        if row[2] != last_doc:
            n_docs, last_doc = n_docs + 1, row[2]
            if n_docs == min_docs:
                yield from ((DROP, *r, None) for r in waiting if r[2] != best)
                waiting = [r for r in waiting if r[2] == best]
        if n_docs >= min_docs and row[2] != best:
            yield (DROP, *row, None)
        else:
            waiting.append(row)
    if key is not None:
        yield from close(True)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, version, n_lines, pos) of every line that goes."""
    order = [F.col("h0"), F.col("h1"), F.col("doc_id")]
    lines = line_hashes(docs, min_chars).repartitionByRange(*order)
    ordered = lines.sortWithinPartitions("h0", "h1", F.desc("doc_id"), "version", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for out in stream(rows, min_docs):
            held.append(out)
            if len(held) == 20_000:
                yield to_batch(held, FOUND)
                held = []
        yield to_batch(held, FOUND)

    found = cut(ordered.mapInArrow(run, FOUND_DDL))
    # Two reports a partition at most: as many rows as a plan has partitions, whatever the input.
    totals = (found.where(f"kind = {REPORT}").groupBy("h0", "h1")
              .agg(F.sum("n_docs").alias("total"), F.max("doc_id").alias("best")).where(f"total >= {int(min_docs)}"))
    settled = (found.where(f"kind = {OPEN}").join(F.broadcast(totals), ["h0", "h1"]).where("doc_id < best"))
    columns = ["doc_id", "version", "n_lines", "pos"]
    return found.where(f"kind = {DROP}").select(*columns).unionAll(settled.select(*columns))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, version, n_lines, n_dropped, keep): a deflated bitmap, a bit a line, of each
    document that loses any.  Documents that lose none have no row."""
    grouped = (dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "version")
               .agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone")))
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_lines", pa.int32()), ("n_dropped", pa.int32()),
                        ("keep", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, v, n, gone in zip(*(c.to_pylist() for c in batch.columns)):
                keep = np.ones(n, bool)
                keep[gone] = False
                rows.append((d, v, n, len(gone), zlib.compress(np.packbits(keep).tobytes())))
            yield to_batch(rows, schema)

    return grouped.mapInArrow(run, "doc_id long, version long, n_lines int, n_dropped int, keep binary")


def apply_bitmap(data: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines, dropped lines, kept text) of a text under a keep bitmap; none keeps all."""
    if keep is None:
        return data.count(b"\n") + 1, 0, data
    lines = data.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)]
    stay = [x for x, k in zip(lines, bits.tolist()) if k]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def _with_bitmaps(docs: DataFrame, carry: Sequence[str], min_chars: int, min_docs: int) -> DataFrame:
    maps = (keep_bitmaps(docs, min_chars, min_docs)
            .select("doc_id", F.col("version").alias("__version"), F.col("keep").alias("__keep")))
    return _documents(docs, carry).join(maps.hint("shuffle_hash"), ["doc_id", "__version"], "left")


def dedup_lines(docs: DataFrame, carry: Sequence[str] = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every document with its kept lines, and the columns named in ``carry``."""
    joined = _with_bitmaps(docs, carry, min_chars, min_docs).select("doc_id", "text", *carry, "__keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                kept = [apply_bitmap(t, k)[2] for t, k in zip(column_bytes(part.column("text")), part.column("__keep").to_pylist())]
                text = pa.array(kept, pa.binary()).cast(part.column("text").type)
                yield part.drop_columns(["__keep"]).set_column(1, "text", text)

    return joined.mapInArrow(run, joined.drop("__keep").schema)


def dedup_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for d, t, k in zip(part.column("doc_id").to_pylist(), column_bytes(part.column("text")), part.column("__keep").to_pylist()):
                    n, gone, kept = apply_bitmap(t, k)
                    rows.append((d, n, gone, hashlib.sha256(kept).hexdigest()))
                yield to_batch(rows, schema)

    joined = _with_bitmaps(docs, (), min_chars, min_docs).select("doc_id", "text", "__keep")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the digest of what stays, for every document."""
    return dedup_digests(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS best FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id < c.best) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL OR k.doc_id >= c.best), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""
