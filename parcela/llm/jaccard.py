"""Exact n-gram Jaccard join in metric space (operator 5).

A document is the set of its distinct word n-grams; Jaccard distance is a
metric, and two documents link at similarity ``num / den`` or more.  Documents
with equal sets are one class.

1. The empty set is the first pivot: it sorts classes into rings by size.  By
   the triangle inequality a link spans neighbouring rings only, so a class
   stands in its own ring and, as a boundary class, in the one below.
2. Unrelated texts lie at distance 1 from each other and from any document
   taken as a pivot, so document pivots cannot divide a corpus.  A ring is
   divided by projections instead: its n-grams are dealt by hash to more parts
   than a link can have differences; linked classes agree wholly on a part, so
   they meet in the cell of that part's content.  Classes that meet in cells
   and whose sketches allow a link make up a region: else sets that share one
   n-gram would join ever larger regions as the corpus grows.  A sketch bounds
   the distance of two sets from below and so parts no linked sets.  A region
   that is still large is dealt again on its own, by those of its n-grams that
   are rarest in it, told by hashed counts and, if that leaves it large, by
   exact ones.
3. Within a region document pivots tell something.  Classes go to the nearest
   pivot (its Voronoi cell) and also to any pivot whose distance is within
   twice the join radius of that, which the triangle inequality proves enough;
   classes far from all pivots have a cell of their own (see ``voronoi``).  Cells are joined in the same way, recursively, until they are small or no
   longer shrink, and then compared exactly through an inverted index.  A
   region too large for a task is divided over tasks, by pivots if that
   divides it and else by pairs of blocks.

No step samples or caps: parts, regions and blocks only decide who is
compared.  ``join_components`` answers connectivity, so within a cell only a
spanning set of links leaves a task; ``join_links`` gives every pair of linked
classes, and each row's number of links.

Defined cases: a null text, or one without words, has the empty set and links
with nothing; a text with fewer words than n is one n-gram of all its words;
rows with a null ``doc_id`` link with nothing and have a null component; rows
that repeat a ``doc_id`` are rows of their own, each in the component of its
text; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.llm.common import chunks, column_bytes, cut, table, to_batch
from parcela.llm.components import components
from parcela.llm.textstats import TextBlock, mix

#: Bytes of text that Python turns into sets at once.
CHUNK = 1 << 20
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


# --- sets -----------------------------------------------------------------------------------------------------------

def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct n-gram hashes of each text, end to end."""
    block = TextBlock(texts)
    coded = block.coded_words(fold=True)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    code = coded.indices.to_numpy()
    word = known[code] if len(code) else np.zeros(0, np.uint64)
    words = np.bincount(block.word_doc, minlength=block.n)
    ends = np.cumsum(words)
    grams = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    gram_ends = np.cumsum(grams)
    doc = np.repeat(np.arange(block.n), grams)
    start = np.arange(len(doc)) - np.repeat(gram_ends - grams, grams) + np.repeat(ends - words, grams)
    h = np.zeros(len(doc), np.uint64)
    for k in range(n):
        inside = start + k < ends[doc]
        step = mix(word[np.minimum(start + k, max(len(word) - 1, 0))] + np.uint64(k + 1)) if len(word) else h
        h = np.where(inside, mix(h ^ step), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.cumsum(np.bincount(doc[first], minlength=block.n))


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    h, ends = shingle_sets(texts, n)
    return np.split(h, ends[:-1]) if len(ends) else []


#: Words of 64 bits of a sketch, at least and at most: sets beyond 49,000 n-grams are told apart less well, no more.
SKETCH_WORDS = (4, 512)


def sketches(h: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Of each set its size, and for each hash bucket whether it holds an odd number of the n-grams.

    Buckets that differ between two sets hold a difference each, so there are at least as
    many differences.  Buckets are a power of two, at least 2 / 3 of the size, so that
    sets with little in common differ in far more buckets than linked ones can.
    """
    size = np.diff(ends, prepend=0)
    least, most = SKETCH_WORDS
    words = np.clip(2 ** np.ceil(np.log2(np.maximum(size, 1) / 96)), least, most).astype(np.int64)
    upto = np.cumsum(words)
    doc = np.repeat(np.arange(len(size)), size)
    bucket = mix(h ^ np.uint64(0x5EED)) & (64 * words[doc] - 1).astype(np.uint64)
    odd = np.bincount(64 * (upto - words)[doc] + bucket.astype(np.int64), minlength=64 * int(words.sum())) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [int(n).to_bytes(8, "little") + bits[8 * (z - w):8 * z] for n, w, z in zip(size, words, upto)]


# --- rings and cells --------------------------------------------------------------------------------------------------

@functools.lru_cache(maxsize=4)
def rings(num: int, den: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size, parts, spare parts) of each ring.

    A set in a ring links only within it or with the next one.  With ``parts``
    equal to the most differences a link can have, plus one, plus ``spare``,
    linked sets agree on more than ``spare`` parts; a set with no more than
    ``spare`` empty parts therefore agrees on one that is not empty.  Zero
    parts: only equal sets link.
    """
    starts, parts, spares = [1], [], []
    while starts[-1] < top:
        first = starts[-1]
        nxt = first * den // num + 1
        starts.append(nxt)
        big = nxt - 1
        most = (big + big * den // num) * (den - num) // (den + num)
        spare = 0
        for _ in range(50):
            empty = (most + 1 + spare) * np.exp(-first / (most + 1 + spare))
            want = int(np.ceil(empty + 4 * np.sqrt(empty) + 1))
            if want <= spare:
                break
            spare = want
            if spare > most + 8:     # tiny sets: empty parts are used like others
                spare = 1
                break
        parts.append(most + 1 + spare if most else 0)
        spares.append(spare)
    return np.array(starts[:-1]), np.array(parts), np.array(spares)


def cell_keys(h: np.ndarray, ends: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, set number) of every part of every set, in its own ring and in the one below."""
    starts, parts, spares = rings(num, den)
    size = np.diff(ends, prepend=0)
    ring = np.searchsorted(starts, size, "right") - 1
    doc = np.repeat(np.arange(len(size)), size)
    low = (h & np.uint64(0xFFFFFFFF)).astype(float)
    high = (h >> np.uint64(32)).astype(float)
    cells, owners = [], []
    for shift in (0, 1):
        level = ring - shift
        m = np.where(level >= 0, parts[np.maximum(level, 0)], 0)
        use = m[doc] > 0
        if not use.any():
            continue
        base = np.cumsum(m) - m
        d = doc[use]
        where = mix(h[use] ^ mix(np.asarray(level[d], np.int64).astype(np.uint64))) % m[d].astype(np.uint64)
        part = base[d] + where.astype(np.int64)
        n = int(m.sum())
        count = np.bincount(part, minlength=n)
        # Sums of 32-bit halves stay below 2 ** 53, so doubles hold them exactly.
        s = mix(np.bincount(part, low[use], n).astype(np.uint64)) ^ np.bincount(part, high[use], n).astype(np.uint64)
        owner = np.repeat(np.arange(len(size)), m)
        number = np.arange(n) - base[owner]
        empty = np.bincount(owner, count == 0, len(size))
        keep = (count > 0) | (empty > spares[np.maximum(level, 0)])[owner]
        key = mix(mix(s) + mix(count + (number << 20)) + mix(np.asarray(level[owner]).astype(np.uint64)))
        cells.append(key[keep])
        owners.append(owner[keep])
    if not cells:
        return np.zeros(0, np.uint64), np.zeros(0, int)
    return np.concatenate(cells), np.concatenate(owners)


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node of a cell to the cell's first, over rows sorted by (cell, node).

    Other partitions may hold the rest of the first and of the last cell: their
    first nodes here are also tied to a node that stands for the cell.
    """
    cell = lo = None
    for batch in batches:
        c, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(c):
            continue
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        new[0] = cell is None or c[0] != cell
        first = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
        root = np.where(first >= 0, v[np.maximum(first, 0)], 0 if lo is None else lo)
        out = root != v
        a, b = v[out], root[out]
        if cell is None:
            a, b = np.append(a, mix(c[:1]).view(np.int64)), np.append(b, v[0])
        cell, lo = c[-1], root[-1]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=PAIR)
    if cell is not None:
        yield pa.RecordBatch.from_arrays([pa.array(mix(np.array([cell])).view(np.int64)), pa.array([lo], pa.int64())], schema=PAIR)


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, bool]]:
    """(rows, first, last): rows sorted by their first column, equal ones together; whether
    the partition begins or ends with them, so that other partitions may hold more of that run."""
    waiting, last, opens = [], None, True        # rows of the run that the next batch may go on with, and those before
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if last is not None and key[-1] != last:
            rows = pa.Table.from_batches([*waiting, batch])
            upto = rows.num_rows - int((key == key[-1]).sum())
            yield rows.slice(0, upto).combine_chunks(), opens, False
            waiting, opens = rows.slice(upto).to_batches(), False
        else:
            waiting.append(batch)
        last = key[-1]
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks(), opens, True


MEETING = pa.schema([("meeting", pa.int64()), ("node", pa.int64())])


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(meeting, node) of rows (cell, node) sorted so: cells with the same nodes are one meeting, and
    cells with one node are none.  A cell that may go on in other partitions is named by itself."""
    for rows, opens, ends in whole_runs(batches):
        cell, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])
        cell, node = cell[fresh], node[fresh]
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(start, append=len(cell))
        name = mix(np.add.reduceat(mix(node), start) + size.astype(np.uint64))
        open_ended = np.zeros(len(start), bool)
        open_ended[0] |= opens
        open_ended[-1] |= ends
        name[open_ended] = mix(cell[start[open_ended]])
        keep = np.repeat(open_ended | (size > 1), size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[keep].view(np.int64)), pa.array(node[keep])], schema=MEETING)


def may_link(sketch: pa.ChunkedArray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sketches numbered ``i`` and ``j`` allow a link of their sets; a null one allows any."""
    sketch = sketch.combine_chunks().cast(pa.large_binary())
    length = np.nan_to_num(pa.compute.binary_length(sketch).to_numpy(zero_copy_only=False)).astype(np.int64) // 8
    held = np.frombuffer(b"".join(x for x in sketch.to_pylist() if x), "<u8")
    start = np.cumsum(length) - length
    good = np.ones(len(i), bool)
    kind = length[i] << 32 | length[j]
    for k in np.unique(kind).tolist():
        m, n = k >> 32, k & 0xFFFFFFFF
        if not m or not n:
            continue
        these = np.flatnonzero(kind == k)
        step = max(1, (1 << 20) // max(m, n))
        for some in (these[x:x + step] for x in range(0, len(these), step)):
            a = held[start[i[some]][:, None] + np.arange(m)]
            b = held[start[j[some]][:, None] + np.arange(n)]
            size, other = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
            a, b = a[:, 1:], b[:, 1:]
            while a.shape[1] > b.shape[1]:       # half as many buckets
                a = a[:, :a.shape[1] // 2] ^ a[:, a.shape[1] // 2:]
            while b.shape[1] > a.shape[1]:
                b = b[:, :b.shape[1] // 2] ^ b[:, b.shape[1] // 2:]
            differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            shared = np.minimum(np.minimum(size, other), (size + other - differ) // 2)
            good[some] = den * shared >= num * (size + other - shared)
    return good


def sketched_stars(num: int, den: int, most: int = 1024):
    """As ``stars``, over rows (meeting, node, sketch), but a node is only tied to those that its
    sketch allows links with, on their own or by way of others.  Meetings of more than
    ``most`` nodes, and those that other partitions may hold more of, are tied as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, opens, ends in whole_runs(batches):
            meeting, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            start = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1])))
            size = np.diff(start, append=len(meeting))
            tested = size <= most
            tested[0] &= not opens
            tested[-1] &= not ends
            root = np.where(np.repeat(tested, size), np.arange(len(node)), np.repeat(start, size))
            after = np.where(np.repeat(tested, size), np.repeat(start + size, size) - 1 - np.arange(len(node)), 0)
            upto, done = np.cumsum(after), 0
            while done < len(node):              # all pairs of some rows with later ones
                z = max(done + 1, int(np.searchsorted(upto, upto[done] - after[done] + (1 << 20), "right")))
                n = after[done:z]
                i = np.repeat(np.arange(done, z), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                good = may_link(rows.column(2).slice(done, z - done + most), i - done, j - done, num, den)
                before = np.flatnonzero(root != np.arange(len(node)))
                i, j, done = np.append(i[good], before), np.append(j[good], root[before]), z
                while len(i):                    # the least of all that reach each other
                    least = np.minimum(root[i], root[j])
                    if (least == root[i]).all() and (least == root[j]).all():
                        break
                    for at in (root[i], root[j], i, j):
                        np.minimum.at(root, at, least)
                    root = root[root]
            tied = root != np.arange(len(node))
            a, b = node[tied], node[root[tied]]
            for at in {*[0] * opens, *[len(start) - 1] * ends}:
                a, b = np.append(a, mix(meeting[start[at]:start[at] + 1]).view(np.int64)), np.append(b, node[start[at]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=PAIR)

    return run


def _meet(cells: DataFrame) -> DataFrame:
    """(node, label): regions of nodes that meet in cells (cell, node).

    Ranges of (cell, node) divide a cell that very many nodes share.
    """
    edges = cells.repartitionByRange("cell", "node").sortWithinPartitions("cell", "node").mapInArrow(stars, "a long, b long")
    return components(edges)


def _meet_by_sketch(cells: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """As ``_meet``, of nodes that meet in cells and whose sketches (node, sketch) allow a link."""
    ranged = cells.repartitionByRange("cell", "node").sortWithinPartitions("cell", "node")
    # The cells are gone before the sketches are dealt; near copies that meet in many cells are dealt once.
    met = cut(ranged.mapInArrow(meetings, "meeting long, node long").distinct())
    dealt = met.join(sketched, "node", "left").select("meeting", "node", "sketch")
    edges = dealt.repartitionByRange("meeting", "node").sortWithinPartitions("meeting", "node").mapInArrow(sketched_stars(num, den), "a long, b long")
    return components(edges)


# --- exact join within a region ----------------------------------------------------------------------------------------

def voronoi(to: np.ndarray, radius: float, reach: float) -> np.ndarray:
    """(pivots + 1, sets): which sets stand in each pivot's cell, and in the last, of sets far from all pivots.

    Of two linked sets, let the one nearer to its nearest pivot p be x.  If x lies
    at ``reach`` or beyond, both are far.  Else the other lies within ``reach``
    plus the radius of p, and no further past its own nearest pivot than twice
    the radius; so both stand in the cell of p.
    """
    nearest = to.min(0)
    own = (to <= nearest + 2 * radius + 1e-9) & (to <= reach + radius + 1e-9)
    return np.vstack([own, nearest >= reach - 1e-9])


class Region:
    """Sets over a common numbering of their n-grams, joined recursively by pivots."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, small: int = 48, pivots: int = 6, every: bool = False):
        self.every = every
        self.num, self.den, self.small, self.pivots = num, den, small, pivots
        self.radius = 1 - num / den
        self.size = np.array([len(s) for s in sets])
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        _, token = np.unique(np.concatenate(sets) if sets else np.zeros(0), return_inverse=True)
        self.token = token
        self.n_tokens = int(token.max(initial=-1)) + 1
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        if self.every:
            self.links.append((x, y))
            return
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the sets, end to end, and for each its place in ``which``."""
        n = self.size[which]
        upto = np.cumsum(n)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.start[which] - (upto - n), n)
        return self.token[at], np.repeat(np.arange(len(which)), n)

    def distances(self, pivot: int, tokens: np.ndarray, owner: np.ndarray, which: np.ndarray) -> np.ndarray:
        inside = np.zeros(self.n_tokens, bool)
        inside[self.token[self.start[pivot]:self.end[pivot]]] = True
        shared = np.bincount(owner, inside[tokens], len(which))
        return 1 - shared / np.maximum(self.size[which] + self.size[pivot] - shared, 1)

    def join(self, which: np.ndarray | None = None) -> None:
        """Finds a spanning set of the links among the sets ``which`` (all, if none); if ``every``,
        all links, some of them in several cells."""
        which = np.arange(len(self.size)) if which is None else which
        if len(which) > self.small:
            tokens, owner = self._gather(which)
            chosen, to = [0], []
            for _ in range(self.pivots):     # each pivot lies farthest from those before
                to.append(self.distances(int(which[chosen[-1]]), tokens, owner, which))
                near = np.min(to, axis=0)
                if near.max() <= self.radius:
                    break
                chosen.append(int(near.argmax()))
            dealt = [voronoi(np.stack(to), self.radius, c) for c in np.arange(0.3, 1.0, 0.1)]
            cells = min(dealt, key=lambda d: int((d.sum(1) ** 2).sum()))     # least left to compare
            if cells.sum(1).max() <= 0.8 * len(which) and cells.sum() <= 1.6 * len(which):
                for c in cells:
                    self.join(which[c])
                return
        self._compare(which)

    def _compare(self, which: np.ndarray) -> None:
        """All links among ``which`` by shared tokens: sets in order of size, each against the later ones."""
        if len(which) < 2:
            return
        which = which[np.argsort(self.size[which], kind="stable")]
        tokens, owner = self._gather(which)
        order = np.argsort(tokens, kind="stable")     # postings of each token, in order of size
        posting = owner[order]
        held = tokens[order]
        size = self.size[which]
        end = np.cumsum(size)
        for i in range(len(which) - 1):
            mine = tokens[end[i] - size[i]:end[i]]
            a, z = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
            n = z - a
            upto = np.cumsum(n)
            hit = posting[np.arange(upto[-1]) + np.repeat(a - (upto - n), n)]
            shared = np.bincount(hit, minlength=len(which))[i + 1:]
            good = np.flatnonzero(self.den * shared >= self.num * (size[i] + size[i + 1:] - shared))
            for j in good.tolist():
                self.link(int(which[i]), int(which[i + 1 + j]))


# --- Spark side -----------------------------------------------------------------------------------------------------

LINK_DDL = "a binary, b binary"
LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, version, n_shingles, class, node, sketch) of every row; equal sets have equal classes.
    ``version`` is the hash of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("node", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=CHUNK):
                h, ends = shingle_sets(column_bytes(part.column("text")), n)
                sets = np.split(h, ends[:-1])
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(names, pa.binary()), pa.array(map(_node, names), pa.int64()), pa.array(sketches(h, ends), pa.binary())], schema=schema)

    return (_texts(docs).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
            .mapInArrow(run, "doc_id long, version long, n_shingles long, class binary, node long, sketch binary"))


def _node(name: bytes) -> int:
    """A class as a 64-bit node.  Should two classes share one, they are compared together, no more."""
    return int.from_bytes(name[:8], "little", signed=True)


def document_cells(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(cell, node) of every document with words and an id."""
    schema = pa.schema([("cell", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=CHUNK):
                texts = list(dict.fromkeys(column_bytes(part.column("text"))))     # a copy adds nothing
                h, ends = shingle_sets(texts, n)
                node = np.array([_node(xxhash.xxh3_128_digest(s.tobytes())) for s in np.split(h, ends[:-1])], np.int64)
                cell, owner = cell_keys(h, ends, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(node[owner])], schema=schema)

    return _texts(docs).where("doc_id IS NOT NULL").select("text").mapInArrow(run, "cell long, node long")


def _rarity(sets: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams of ``sets`` fall into each of ``buckets`` hash buckets of (region, n-gram)."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "grams", CHUNK):
                raw = part.column("grams").to_pylist()
                h = np.frombuffer(b"".join(raw), "<u8")
                region = np.repeat(part.column("region").to_numpy(), [len(r) // 8 for r in raw])
                bucket, n = np.unique(mix(h ^ mix(region)) % np.uint64(buckets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n)], schema=schema)

    counts = np.zeros(buckets, np.int32)
    # At most ``buckets`` rows, whatever the input.
    found = sets.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.least(F.sum("n"), F.lit(2 ** 31 - 1)).cast("int").alias("n")).toArrow()
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefix_cells(h: np.ndarray, ends: np.ndarray, region: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, set number): each set's rarest n-grams, so many that linked sets have one of these in common.

    A link needs ``num / den`` of either set in common; of a set of size n, the first
    n less that share, plus one, in any order common to all sets, cannot all be missing.
    """
    size = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(size)), size)
    key = mix(h ^ mix(region)[doc])
    order = np.lexsort((key, counts[key % np.uint64(len(counts))], doc))
    place = np.arange(len(h)) - np.repeat(ends - size, size)
    first = place < (size + 1 + -(num * size) // den)[doc]     # n - ceil(n num / den) + 1
    return key[order][first], doc[first]


def _rare_cells(sets: DataFrame, num: int, den: int, buckets: int = 1 << 22) -> DataFrame:
    """(cell, node): sets of a region meet in rare n-grams that both hold.

    Rarity is the count of an n-gram's hash bucket.  The buckets are a bounded
    broadcast; how fine they are decides who meets, never whether linked sets do.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_rarity(sets, buckets))
    schema = pa.schema([("cell", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "grams", CHUNK):
                raw = part.column("grams").to_pylist()
                h = np.frombuffer(b"".join(raw), "<u8")
                ends = np.cumsum([len(r) // 8 for r in raw])
                cell, owner = prefix_cells(h, ends, part.column("region").to_numpy(), counts.value, num, den)
                node = np.array([_node(x) for x in part.column("class").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(node[owner])], schema=schema)

    return sets.mapInArrow(run, "cell long, node long")


#: The number of rows of a key that several partitions may hold; each of them says so.
MANY = (1 << 31) - 1
HELD = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("need", pa.int64())])
SHARED = HELD.append(pa.field("n", pa.int32()))


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, need) sorted by key, those of keys in two rows or more, with their number ``n``.

    The first and the last key may go on in other partitions: their number is ``MANY`` wherever they stand.
    """
    def counted(rows: pa.Table, opens: bool, ends: bool) -> pa.RecordBatch:
        key = rows.column("key").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(start, append=len(key))
        number = np.minimum(size, MANY)
        if opens:
            number[0] = MANY
        if ends:
            number[-1] = MANY
        n = np.repeat(number, size).astype(np.int32)
        out = rows.append_column("n", pa.array(n)).filter(pa.array(n > 1)).combine_chunks()
        return out.to_batches()[0] if out.num_rows else to_batch([], SHARED)

    for rows, opens, ends in whole_runs(batches):
        yield counted(rows, opens, ends)


def _counted_cells(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(cell, node): sets of a region meet in the rarest n-grams that both hold, by exact numbers of sets.

    An n-gram of no other set links nothing.  Of the s others of a set, in any order
    common to all sets, the first s less those a link needs, plus one, cannot all be
    missing; a set that shares fewer than a link needs has no cell.  The n-grams are
    counted where their occurrences meet, so nothing is broadcast and a count stays
    a count however many sets there are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "grams", CHUNK):
                raw = part.column("grams").to_pylist()
                size = np.array([len(r) // 8 for r in raw], np.int64)
                key = mix(np.frombuffer(b"".join(raw), "<u8") ^ mix(np.repeat(part.column("region").to_numpy(), size)))
                node = np.array([_node(x) for x in part.column("class").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(node, size)), pa.array(np.repeat(-(-num * size // den), size))], schema=HELD)

    held = sets.mapInArrow(run, "key long, node long, need long")
    shared = held.repartitionByRange("key", "node").sortWithinPartitions("key").mapInArrow(shared_keys, "key long, node long, need long, n int")
    mine = Window.partitionBy("node")
    place = F.row_number().over(mine.orderBy("n", "key"))
    return (shared.select("key", "node", (F.count("*").over(mine) - F.col("need") + 1).alias("_first"), place.alias("_place"))
            .where("_place <= _first").select(F.col("key").alias("cell"), "node"))


def _member_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(region, total, class, grams) of the classes in ``members`` (doc_id, version, class, region, total).
    Rows that repeat id and text are one before they are dealt, so a class sends one set."""
    schema = pa.schema([("region", pa.int64()), ("total", pa.int64()), ("class", pa.binary()), ("grams", pa.binary())])
    texts = (_texts(docs).where("doc_id IS NOT NULL").withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
             .groupBy("doc_id", "version").agg(F.min("text").alias("text"))
             .join(members.hint("shuffle_hash"), ["doc_id", "version"]).select("text", "region", "total", "class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=CHUNK):
                raw = [s.tobytes() for s in _sets(column_bytes(part.column("text")), n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("region", "total", "class")), pa.array(raw, pa.binary())], schema=schema)

    return texts.mapInArrow(run, "region long, total long, class binary, grams binary")


def _join_groups(sets: DataFrame, keys: list[str], num: int, den: int, every: bool = False) -> DataFrame:
    """Links within each group of ``keys`` by region; a group holds several small regions."""

    def run(group: pa.Table) -> pa.Table:
        by_region: dict[tuple, dict[bytes, bytes]] = {}
        names = zip(*(group.column(c).to_pylist() for c in ("region", "part", "class", "grams")))
        for region, part, name, grams in names:
            by_region.setdefault((region, part), {})[name] = grams
        links = []
        for found in by_region.values():
            if len(found) > 1:
                order = sorted(found)
                joined = Region([np.frombuffer(found[x], "<u8") for x in order], num, den, every=every)
                joined.join()
                pairs = {(min(x), max(x)) for x in joined.links} if every else joined.links
                links += [(order[a], order[b]) for a, b in pairs]
        return pa.Table.from_batches([to_batch(links, LINK)])

    # A stated number of partitions: few bytes can be much to compare, and adaptive execution would merge by bytes.
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, LINK_DDL)


def _by_pivots(large: DataFrame, num: int, den: int, slice_grams: int, pivots: int = 16) -> DataFrame:
    """(region, part, class, size): classes of large regions dealt to the Voronoi cells of document
    pivots, boundary classes to several.  Pivots are each region's first classes by hash."""
    slices = F.ceil(F.col("total") / slice_grams).cast("int")
    picked = (large.withColumn("_n", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("class"), "class")))
              .where(F.col("_n") <= pivots).drop("_n"))
    sliced = large.withColumn("slice", F.pmod(F.xxhash64("class", F.lit(1)), slices).cast("int"))
    pivot_rows = (picked.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
                  .select(*(F.col(c).alias(c) for c in ("region", "class", "grams", "slice"))))     # columns of its own
    schema = pa.schema([("region", pa.int64()), ("part", pa.int32()), ("class", pa.binary()), ("size", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            names, grams = left.column("class").to_pylist(), left.column("grams").to_pylist()
            centres = sorted(zip(right.column("class").to_pylist(), right.column("grams").to_pylist()))
            held = Region([np.frombuffer(g, "<u8") for g in [*grams, *(g for _, g in centres)]], num, den)
            which = np.arange(len(names))
            tokens, owner = held._gather(which)
            to = np.stack([held.distances(len(names) + k, tokens, owner, which) for k in range(len(centres))])
            region = left.column("region")[0].as_py()
            cells = voronoi(to, held.radius, 1 - 2 * held.radius)
            rows = [(region, k, names[i], len(grams[i]) // 8) for k, c in enumerate(cells) for i in np.flatnonzero(c).tolist()]
        return pa.Table.from_batches([to_batch(rows, schema)])

    return (sliced.groupBy("region", "slice").cogroup(pivot_rows.groupBy("region", "slice"))
            .applyInArrow(run, "region long, part int, class binary, size long"))


def _block_pairs(sets: DataFrame, totals: DataFrame, keys: list[str], task_grams: int) -> DataFrame:
    """Every pair of blocks of each oversized group as a group (..., i, j) of its own; blocks hold half a task."""
    blocks = totals.select(*keys, F.ceil(2 * F.col("grams_total") / task_grams).cast("int").alias("blocks"))
    dealt = sets.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("class", F.lit(2)), F.col("blocks")).cast("int"))
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .select(*sets.columns, "i", "j"))


def _in_rings(large: DataFrame, num: int, den: int) -> DataFrame:
    """(region, part, class, grams): sets by ring of size, boundary sets in two: each set stands in its
    own ring and the one below, so linked sets meet in the ring of the smaller."""
    starts = F.array(*[F.lit(int(x)) for x in rings(num, den)[0]])
    size = F.octet_length("grams") / 8
    ring = F.size(F.filter(starts, lambda x: x <= size))
    return large.select("region", F.explode(F.array(ring, ring - 1)).alias("part"), "class", "grams")


def region_links(sets: DataFrame, num: int, den: int, task_grams: int = 1_000_000, every: bool = False) -> DataFrame:
    """Spanning links (a, b) of classes within the regions of ``sets`` (region, total, class, grams);
    if ``every``, all links, with repeats where classes meet in several parts.

    ``task_grams`` bounds the n-grams that one task compares at once.  Small
    regions go to a task together.  A larger one is dealt once more by rare
    n-grams, which parts sets that met because many share a passage, by hashed and
    then by exact counts; what is still large is divided by pivots, or, where pivots do not divide it, by size;
    parts that exceed two tasks are compared by pairs of blocks.
    """
    # Each kind of part is joined and written by itself: its copies of the sets are gone before the next are made.
    links = []
    for deal in (_rare_cells, _counted_cells, None):
        small = sets.where(F.col("total") <= task_grams)
        # Buckets of about a quarter of a task, and never over a task and a quarter.
        n = small.agg(F.sum(F.octet_length("grams") / 8)).first()[0] or 0
        bucket = F.pmod(F.xxhash64("region"), F.lit(max(1, int(-(-4 * n // task_grams))))).cast("int")
        small = small.select("region", F.lit(0).alias("part"), "class", "grams", bucket.alias("bucket"))
        links.append(cut(_join_groups(small, ["bucket"], num, den, every)))
        large = sets.where(F.col("total") > task_grams)
        del small
        if large.isEmpty():
            return _union(links)
        if deal:
            found = cut(_meet(deal(large, num, den)).select("node", F.col("label").alias("_to")))
            sizes = _with_node(large.select("class", (F.octet_length("grams") / 8).alias("size")))
            regions = found.join(sizes.join(found, "node").groupBy("_to").agg(F.sum("size").cast("long").alias("_total")), "_to")
            sets = cut(_with_node(large.drop("total")).join(regions, "node")
                       .select(F.col("_to").alias("region"), F.col("_total").alias("total"), "class", "grams"))
            del large
    dealt = cut(_by_pivots(large, num, den, task_grams))
    parts = dealt.groupBy("region", "part").agg(F.sum("size").alias("grams_total"))
    # Pivots divide a region if its cells hold no more than twice its sets between them.
    copies = dealt.groupBy("region").agg(F.sum("size").alias("_held"))
    divided = cut(large.select("region", "total").distinct().join(copies, "region").where("_held <= 2 * total").select("region"))
    whole = _in_rings(large.join(divided, "region", "left_anti"), num, den)
    in_cells = large.join(dealt.join(divided, "region", "left_semi").drop("size"), ["region", "class"]).select("region", "part", "class", "grams")
    ringed = whole.groupBy("region", "part").agg(F.sum(F.octet_length("grams") / 8).cast("long").alias("grams_total"))
    totals = cut(parts.join(divided, "region", "left_semi").unionAll(ringed).select("region", "part", "grams_total"))
    fits = totals.where(F.col("grams_total") <= task_grams).select("region", "part")
    beyond = totals.where(F.col("grams_total") > task_grams)
    for spread in (in_cells, whole):
        links.append(cut(_join_groups(spread.join(fits, ["region", "part"]), ["region", "part"], num, den, every)))
        links.append(cut(_join_groups(_block_pairs(spread, beyond, ["region", "part"], 2 * task_grams), ["region", "part", "i", "j"], num, den, every)))
    return _union(links)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionAll(more)
    return out


def _with_node(frame: DataFrame) -> DataFrame:
    """Adds ``node``, the class's first eight bytes as a little-endian long."""
    schema = frame.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [_node(x) for x in batch.column("class").to_pylist()]
            yield batch.append_column("node", pa.array(node, pa.int64()))

    return frame.mapInArrow(run, f"{', '.join(c.replace(':', ' ', 1) for c in schema.split(','))}, node long")


def _rows_and_sets(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes of all rows, those of rows that can link, and the sets of every region of two classes or more."""
    rows = cut(classes(docs, n))
    named = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = named.groupBy("class", "node", "n_shingles").agg(F.min(F.struct("doc_id", "version")).alias("r"))
    # Should two classes share a node, it has no sketch and is tied to all that it meets.
    sketched = named.groupBy("node").agg(F.min("sketch").alias("_a"), F.max("sketch").alias("_z")).select("node", F.expr("IF(_a = _z, _a, NULL)").alias("sketch"))
    regions = _meet_by_sketch(document_cells(docs, n, num, den), sketched, num, den).withColumnRenamed("label", "region")
    members = cut(first.join(regions, "node").select("r.doc_id", "r.version", "class", "region", "n_shingles"))
    alone = members.groupBy("region").agg(F.sum("n_shingles").cast("long").alias("total"), F.count("*").alias("_rows")).where("_rows > 1")
    members = members.join(alone, "region").select("doc_id", "version", "class", "region", "total")
    sets = cut(_member_sets(docs, members, n))
    return rows, named, sets


def join_links(docs: DataFrame, n: int, num: int, den: int, task_grams: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, n_shingles, class, n_links) of every row, and (a, b) of every pair of linked classes, once, a < b.

    ``n_links`` counts the other rows at similarity ``num / den`` or more, those
    of the row's own class included.
    """
    rows, named, sets = _rows_and_sets(docs, n, num, den)
    found = region_links(sets, num, den, task_grams, every=True)
    pairs = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sizes = named.groupBy("class").agg(F.count("*").alias("_rows"))
    both = pairs.unionAll(pairs.select("b", "a")).toDF("class", "other")
    beside = (both.join(sizes.select(F.col("class").alias("other"), "_rows"), "other").groupBy("class").agg(F.sum("_rows").alias("_beside")))
    counted = (sizes.join(beside, "class", "left")
               .select("class", (F.col("_rows") - 1 + F.coalesce("_beside", F.lit(0))).alias("_links")))
    links = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.lit(0)).otherwise(F.col("_links")).cast("long")
    return rows.join(counted, "class", "left").select("doc_id", "version", "n_shingles", "class", links.alias("n_links")), pairs


def join_components(docs: DataFrame, n: int, num: int, den: int, task_grams: int = 1_000_000) -> DataFrame:
    """(doc_id, version, n_shingles, component_id) of every row: the smallest ``doc_id`` that links
    of similarity ``num / den`` or more reach, the row's own included."""
    rows, named, sets = _rows_and_sets(docs, n, num, den)
    merged = components(region_links(sets, num, den, task_grams)).select(F.col("node").alias("class"), "label")
    label = F.coalesce(F.col("label"), F.col("class"))
    smallest = (named.groupBy("class").agg(F.min("doc_id").alias("least")).join(merged, "class", "left")
                .select("class", label.alias("label"), "least"))
    per_label = smallest.groupBy("label").agg(F.min("least").alias("component_id"))
    answer = smallest.join(per_label, "label").select("class", "component_id")
    linked = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(answer, "class", "left").select("doc_id", "version", "n_shingles", linked.alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 3-grams, similarity 0.9."""
    return join_components(table(spark, sf_dir, "documents"), 3, 90, 100).drop("version")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 1),
                           lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS s
  FROM w
), grams AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT shared.a, shared.b FROM shared JOIN sets x ON x.doc_id = shared.a JOIN sets y ON y.doc_id = shared.b
  WHERE 100 * k >= 90 * (len(x.s) + len(y.s) - k)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT sets.doc_id, len(s) AS n_shingles, min(reach.b) AS component_id
FROM sets JOIN reach ON reach.a = sets.doc_id GROUP BY sets.doc_id, s
"""
