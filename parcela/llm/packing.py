"""Hierarchical multi-length packing (operator 6).

Each document becomes its ids plus one end id.  Whole windows are cut off
first; the rest of a document goes to the smallest context-size tier that
holds it.  Every tier is packed by first-fit in decreasing order; gaps of the
longer windows are filled from shorter tiers, whole pieces first and at last
a piece cut to the gap.  Windows that are still open are closed, fullest first,
with pieces of the emptiest ones of their tier, so that a flush leaves less than a
window a tier, whatever the documents' lengths.  What a task has left at its end is laid end to end
and cut at powers of two, which need no padding.  Sequences of a flush are
dealt to step groups so that the groups' attention costs are alike.

Packing is local to a task's input split: nothing is shuffled, a lost task is
packed again from the same rows, and no split pads anything.

Defined cases: a null text is empty and packs its end id alone; a null
``doc_id`` stays null; repeated rows are packed once each; an empty table
gives no row; a text of any length is encoded in bounded runs.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import chunks, column_bytes, table, to_batch
from parcela.llm.fragments import encoder

VOCABULARY = "word_bpe_49k.json"
END = (1).to_bytes(4, "little")
TIERS = (256, 512, 1024, 2048)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("tier", pa.int32()), ("step_group", pa.int64())])
DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
       "tier int, step_group long")


class Packer:
    """Packs the pieces of one task.  A piece is (length, start, doc_id, doc_tokens, ids)."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, flush_windows: int = 256, step_windows: int = 16):
        self.tiers = tuple(sorted(tiers))
        self.window = self.tiers[-1]
        self.flush_at = flush_windows * self.window
        self.step_tokens = step_windows * self.window
        self.pools: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.held = 0
        self.next_sequence = self.next_step = task << 36
        self.full: list[tuple[int, list[tuple]]] = []   # (tier, pieces) of complete sequences

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Routes a document: whole windows now, the rest to its tier."""
        n = len(ids) // 4
        start = 0
        while n - start >= self.window:
            self.full.append((self.window, [(self.window, start, doc_id, n, ids[4 * start:4 * (start + self.window)])]))
            start += self.window
        if n > start:
            self._pool((n - start, start, doc_id, n, ids[4 * start:]))
        self.held += n

    def _pool(self, piece: tuple) -> None:
        tier = next(t for t in self.tiers if t >= piece[0])
        self.pools[tier].append(piece)

    @staticmethod
    def _split(piece: tuple, k: int) -> tuple[tuple, tuple]:
        n, start, doc_id, total, ids = piece
        return (k, start, doc_id, total, ids[:4 * k]), (n - k, start + k, doc_id, total, ids[4 * k:])

    def pack(self) -> None:
        """Packs the pools; less than one window a tier stays unpacked."""
        order = lambda p: (p[0], p[1], -1 if p[2] is None else p[2])
        pools = {t: sorted(p, key=order) for t, p in self.pools.items()}
        self.pools = {t: [] for t in self.tiers}
        for at in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[at]
            windows: list[tuple[int, list[tuple]]] = []      # (gap, pieces)
            gaps: list[tuple[int, int]] = []                 # sorted (gap, window)
            for piece in reversed(pools[tier]):
                k = bisect_right(gaps, (piece[0] - 1, len(pools[tier]) + len(windows)))
                if k < len(gaps):
                    gap, w = gaps.pop(k)
                    windows[w] = (gap - piece[0], [*windows[w][1], piece])
                else:
                    w = len(windows)
                    windows.append((tier - piece[0], [piece]))
                if windows[w][0]:
                    insort(gaps, (windows[w][0], w))
            pools[tier] = []
            unfilled: list[tuple[int, list[tuple]]] = []
            for gap, pieces in windows:
                for lower in range(at - 1, -1, -1):          # whole pieces of shorter tiers, longest first
                    pool = pools[self.tiers[lower]]
                    while gap and pool and (k := bisect_right(pool, gap, key=lambda p: p[0])):
                        piece = pool.pop(k - 1)
                        pieces.append(piece)
                        gap -= piece[0]
                if gap and (lower := next((i for i in range(at) if pools[self.tiers[i]]), None)) is not None:
                    head, rest = self._split(pools[self.tiers[lower]].pop(0), gap)
                    pieces.append(head)
                    gap = 0
                    insort(pools[next(t for t in self.tiers if t >= rest[0])], rest, key=order)
                if gap:
                    unfilled.append((gap, pieces))
                else:
                    self.full.append((tier, pieces))
            # Close as many windows as the tokens allow, fullest first; the emptiest ones are cut up for it.
            unfilled.sort(key=lambda w: w[0])
            closing = sum(tier - gap for gap, _ in unfilled) // tier
            spare = [p for _, pieces in unfilled[closing:] for p in pieces]
            for gap, pieces in unfilled[:closing]:
                while gap:
                    piece = spare.pop()
                    if piece[0] > gap:
                        piece, more = self._split(piece, gap)
                        spare.append(more)
                    pieces.append(piece)
                    gap -= piece[0]
                self.full.append((tier, pieces))
            for piece in spare:                              # less than one window of the tier
                self._pool(piece)

    def flush(self, last: bool = False) -> list[tuple]:
        """Rows of all complete sequences; at the last flush also of what is left, cut at powers of two."""
        self.pack()
        if last:
            rest = [p for t in self.tiers for p in reversed(self.pools[t])]
            self.pools = {t: [] for t in self.tiers}
            left = sum(p[0] for p in rest)
            while left:
                size = min(self.window, 1 << (left.bit_length() - 1))
                pieces, gap = [], size
                while gap:
                    piece = rest.pop()
                    if piece[0] > gap:
                        piece, more = self._split(piece, gap)
                        rest.append(more)
                    pieces.append(piece)
                    gap -= piece[0]
                self.full.append((size, pieces))
                left -= size
        rows: list[tuple] = []
        for tier, pieces, step in self._steps():
            offset = 0
            for n, start, doc_id, total, ids in pieces:
                rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_sequence, offset, tier, step))
                offset += n
            self.next_sequence += 1
        self.full = []
        self.held = sum(p[0] for t in self.tiers for p in self.pools[t])
        return rows

    def _steps(self) -> Iterator[tuple[int, list[tuple], int]]:
        """Deals sequences to step groups, the costliest first, each to the lightest group."""
        tokens = sum(t for t, _ in self.full)
        groups = [(0, self.next_step + g) for g in range(max(1, -(-tokens // self.step_tokens)))]
        self.next_step += len(groups)
        cost = [(sum(p[0] * p[0] for p in pieces) + tier, i) for i, (tier, pieces) in enumerate(self.full)]
        for c, i in sorted(cost, key=lambda x: (-x[0], x[1])):
            load, g = heapq.heappop(groups)
            heapq.heappush(groups, (load + c, g))
            yield *self.full[i], g


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, tiers: tuple[int, ...] = TIERS, flush_windows: int = 256,
         step_windows: int = 16) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence.

    ``flush_windows`` bounds what a task holds: it packs whenever that many of
    the longest windows of tokens wait.  ``step_windows`` is the token budget of
    a step group, in longest windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        context = TaskContext.get()
        packer = Packer(context.partitionId() if context else 0, tiers, flush_windows, step_windows)
        for batch in batches:
            for part in chunks(batch):
                ids = bpe.encode_many(column_bytes(part.column("text")))
                for d, i in zip(part.column("doc_id").to_pylist(), ids):
                    packer.add(d, i + END)
                    if packer.held >= packer.flush_at:
                        yield to_batch(packer.flush(), SCHEMA)
        yield to_batch(packer.flush(last=True), SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, DDL)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
