"""Vector code compression: product quantisation with memoised grid cells (operator 12).

A vector of scaled integer components is cut into consecutive parts; each
part position has a codebook, and a vector's code is the index of the
nearest entry for each part.  Codebooks come from rounds of assignment and
componentwise floored means over all vectors.

The nearest entry is found through a grid: a part's coarse cell is a box of
``cell`` units a side, looked up by its hash.  For a cell met for the first
time the distances from the box to every entry are bounded below and above;
an entry whose least distance exceeds the smallest greatest distance is
dominated everywhere in the box.  The others are remembered with the cell, and only
they are evaluated exactly for the vectors in it, ties to the lower index.
A task's memory of cells is bounded: a full one is emptied and filled again,
which changes no result.

A round is one pass: each task adds up counts and sums of the entries it
used, and the sums of all tasks, at most ``parts * entries`` rows, go to the
driver for the next codebooks.  What executors are sent is the codebooks,
whose size does not depend on the table.

Defined cases: rows whose vector is null, or holds a null or non-finite
component, are left out.  Components beyond 32768 in size count as that.
The vector of the smallest vec_id (ties: the smaller vector; a null id comes
last) sets the length; vectors of another length are left out.  If the length is
no multiple of ``parts``, the first parts are one longer.  Rows that repeat a vec_id are
vectors of their own.  With fewer vectors than entries the codebooks are as
short; without any the result is empty.  Null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import cut, ship, table

#: Scaled components are held within this, so that a squared distance of 2048 components fits 63 bits.
LIMIT = 1 << 25


def scaled(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, label, q): floor(scale * x) of every usable vector."""
    x = F.col("embedding").cast("array<double>")
    usable = F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    whole = lambda v: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), v * scale))).cast("int")
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                           F.transform(x, whole).alias("q"))


def part_bounds(length: int, parts: int) -> list[int]:
    """Where the parts of a vector start, and its end."""
    size, more = divmod(length, parts)
    return [k * size + min(k, more) for k in range(parts + 1)]


def box_distances(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance from each box (inclusive corners) to each entry."""
    least = np.zeros((len(low), len(entries)), np.int64)
    most = np.zeros_like(least)
    for k in range(low.shape[1]):
        under = low[:, k, None] - entries[None, :, k]
        over = entries[None, :, k] - high[:, k, None]
        least += np.maximum(np.maximum(under, over), 0) ** 2
        most += np.maximum(np.abs(under), np.abs(over)) ** 2
    return least, most


class GridCodebook:
    """Nearest entries of one part position, by remembered grid cells."""

    def __init__(self, entries: np.ndarray, cell: int, max_cells: int = 65_536) -> None:
        self.entries, self.cell, self.max_cells = entries, cell, max_cells
        self.cells: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        keys = [c.tobytes() for c in cells]
        new = [i for i, key in enumerate(keys) if key not in self.cells]
        if len(self.cells) + len(new) > self.max_cells:
            self.cells.clear()
            new = list(range(len(keys)))
        for start in range(0, len(new), 256):
            some = new[start:start + 256]
            low = cells[some] * self.cell
            least, most = box_distances(low, low + (self.cell - 1), self.entries)
            keep = least <= most.min(1, keepdims=True)
            for i, row in zip(some, keep):
                self.cells[keys[i]] = np.flatnonzero(row)
        return [self.cells[key] for key in keys]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry for each row, ties to the lower index."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        cells, of = np.unique(x // self.cell, axis=0, return_inverse=True)
        of = of.reshape(-1)
        index = np.zeros(len(x), np.int64)
        best = np.zeros(len(x), np.int64)
        for start in range(0, len(cells), self.max_cells):
            some = self._candidates(np.ascontiguousarray(cells[start:start + self.max_cells]))
            sizes = np.array([len(c) for c in some])
            begin = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate(some)
            rows = np.flatnonzero((of >= start) & (of < start + len(some)))
            step = max(1, int(4_000_000 // max(1, sizes.max())))
            for at in range(0, len(rows), step):
                mine = rows[at:at + step]
                cell = of[mine] - start
                n = sizes[cell]
                first = np.concatenate([[0], np.cumsum(n)])[:-1]
                row = np.repeat(np.arange(len(mine)), n)
                entry = flat[np.arange(len(row)) - first[row] + begin[cell][row]]
                self.evaluated += len(row)
                d = np.zeros(len(row), np.int64)
                for k in range(x.shape[1]):
                    d += (x[mine, k][row] - self.entries[entry, k]) ** 2
                least = np.minimum.reduceat(d, first)
                hit = np.flatnonzero(d == least[row])
                _, lowest = np.unique(row[hit], return_index=True)      # candidates ascend: the first is the lowest
                index[mine], best[mine] = entry[hit[lowest]], least
        return index, best


@dataclass
class Codebooks:
    """Entries of each part position; ``bounds`` are the parts' starts and the end."""

    entries: list[np.ndarray]
    bounds: list[int]
    cell: int

    def grids(self) -> list[GridCodebook]:
        return [GridCodebook(e, self.cell) for e in self.entries]

    def split(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        column = batch.column("q")
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), self.bounds[-1])
        return [x[:, a:b] for a, b in zip(self.bounds, self.bounds[1:])]

    def sha256(self) -> str:
        """Over all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.reshape(-1).tolist()).encode()).hexdigest()


def refine(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, entries to their parts' floored means."""
    width = max((b - a for a, b in zip(books.bounds, books.bounds[1:])), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = books.grids()
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            for k, x in enumerate(books.split(batch)):
                index, _ = grids[k].nearest(x)
                counts[k] += np.bincount(index, minlength=len(counts[k]))
                np.add.at(sums[k], index, x)
        out = [(k, e, int(counts[k][e]), sums[k][e].tolist()) for k in range(len(grids)) for e in np.flatnonzero(counts[k]).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                                             ["part", "entry", "n", "sums"])

    used = rows.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = used.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    entries = [e.copy() for e in books.entries]
    for r in totals.collect():                  # at most parts * entries rows
        size = entries[r.part].shape[1]
        entries[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(size)]
    return Codebooks(entries, books.bounds, books.cell)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = books.grids()
        for batch in batches:
            found = [grid.nearest(x) for grid, x in zip(grids, books.split(batch))]
            index = np.stack([i for i, _ in found], 1).astype(np.uint8)
            codes = [row.tobytes().hex() for row in index]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()),
                                              pa.array(sum(d for _, d in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label long, code string, error long")


def train(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, cell: int = 256) -> Codebooks | None:
    """Codebooks started from the first ``entries`` (up to 256) rows by id; None without rows."""
    if entries > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(1).collect()
    if not first:
        return None
    alike = rows.where(F.size("q") == len(first[0].q))
    start = np.array([r.q for r in alike.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()], np.int64)
    bounds = part_bounds(len(first[0].q), parts)
    books = Codebooks([start[:, a:b].copy() for a, b in zip(bounds, bounds[1:])], bounds, cell)
    for _ in range(rounds):
        books = refine(alike, books)
    return books


def compress(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, cell: int = 256) -> DataFrame:
    """(vec_id, code, error, label, label_error, codebooks_sha256) of every usable vector.

    ``error`` is the squared distance to the code's entries, ``label_error``
    its sum over the rows of the same label.
    """
    ship(embeddings.sparkSession)
    rows = cut(scaled(embeddings, scale))
    books = train(rows, parts, entries, rounds, cell)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label",
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = cut(encode(rows.where(F.size("q") == books.bounds[-1]), books))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", "code", "error", "label", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector: 4 parts, 256 entries, 4 rounds."""
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by comparing every part with every entry."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, q) - 1 AS r, vec_id, label, q FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (
  SELECT r, part, x, list_inner_product(x, x) AS xx FROM (
    SELECT r, part, list_slice(q, CAST(part * len(q) / {parts} AS BIGINT) + 1, CAST((part + 1) * len(q) / {parts} AS BIGINT)) AS x
    FROM v, range({parts}) t(part))
), c0 AS MATERIALIZED (SELECT part, r AS entry, x AS e FROM p WHERE r < {entries})"""]
    near = lambda k: f"""a{k} AS MATERIALIZED (
  SELECT p.part, p.r, any_value(p.x) AS x,
         min(CAST(p.xx - 2 * list_inner_product(p.x, c.e) + list_inner_product(c.e, c.e) AS BIGINT) * {entries} + c.entry) AS best
  FROM p JOIN c{k} c ON c.part = p.part GROUP BY p.part, p.r
)"""  # noqa: E731
    for k in range(rounds):
        steps.append(near(k))
        steps.append(f"""s{k} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM (
    SELECT part, best % {entries} AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY part, entry
), c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(s.e, c.e) AS e FROM c{k} c LEFT JOIN s{k} s ON s.part = c.part AND s.entry = c.entry
)""")
    steps.append(near(rounds))
    steps.append(f"""h AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM c{rounds})
), o AS (
  SELECT r, string_agg(lower(printf('%02x', best % {entries})), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r
)
SELECT v.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM v JOIN o ON o.r = v.r CROSS JOIN h""")
    return "WITH " + ", ".join(steps)


OP12_SQL = _sql()
