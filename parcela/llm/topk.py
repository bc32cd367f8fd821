"""Exact top-k inner products by KD-trees over shards (operator 2).

Component x becomes floor(256 x), x as double.  A coarse tree, fitted on a
bounded sample by median splits, deals the distinct vectors to shards; every
shard builds its own KD-tree with tight bounding boxes.  Each query searches
its home shard best-first, the node with the largest possible inner product
first.  The k-th score found there goes along to the other shards: a shard
whose box cannot reach it is not visited, and visited trees start from it.

Of equal vectors only k rows an id, and of these the 2k with the smallest
ids, can ever be in a result, so a vector that a third of all rows hold costs
no more than 2k rows; equal queries are searched once, but for those whose id
other rows repeat: their search leaves out the rows of that id.  Queries meet a shard in blocks of bounded size.
The search is exact; the sample decides only where shards are cut.

Defined cases: rows with a null id, a null vector or a null or non-finite
component take no part; vectors are compared with those of their own length
(the empty vector scores 0 with other empty ones); rows that repeat an id
are all candidates of other ids, a candidate once for each, and the results of their queries are
ranked together; scores beyond the range of a
long are cut to it before they are ordered; an empty table gives an empty result; other columns are
left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.llm.common import cut, table

FOUND = pa.schema([("kind", pa.int8()), ("vkey", pa.binary()), ("shard", pa.int64()), ("vec", pa.binary()), ("score", pa.int64()),
                   ("vec_id", pa.int64()), ("own", pa.int64())])
FOUND_DDL = "kind tinyint, vkey binary, shard long, vec binary, score long, vec_id long, own long"
HIT, ASK, BOX = 0, 1, 2
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


# --- trees ----------------------------------------------------------------------------------------------------------

@dataclass
class Splits:
    """A tree of median splits over the widest dimension.  Leaves have ``dim`` -1 and number ``left``."""

    dim: list[int]
    value: list[float]
    left: list[int]
    right: list[int]
    leaves: int = 0

    @classmethod
    def fit(cls, points: np.ndarray, n_leaves: int) -> Splits:
        tree = cls([], [], [], [])
        tree._grow(points, n_leaves)
        return tree

    def _grow(self, points: np.ndarray, n_leaves: int) -> int:
        node = len(self.dim)
        self.dim.append(-1)
        self.value.append(0.0)
        self.left.append(0)
        self.right.append(0)
        spread = np.ptp(points, axis=0) if len(points) and points.shape[1] else np.zeros(1)
        if n_leaves > 1 and spread.max() > 0:
            d = int(spread.argmax())
            v = float(np.median(points[:, d]))
            low = points[:, d] < v
            if not low.any():
                v = float(np.nextafter(points[:, d].min(), np.inf))
                low = points[:, d] < v
            self.dim[node], self.value[node] = d, v
            self.left[node] = self._grow(points[low], n_leaves // 2)
            self.right[node] = self._grow(points[~low], n_leaves - n_leaves // 2)
        else:
            self.left[node] = self.leaves
            self.leaves += 1
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        dim, value, left, right = (np.array(x) for x in (self.dim, self.value, self.left, self.right))
        at = np.zeros(len(points), int)
        while (inner := np.flatnonzero(dim[at] >= 0)).size:
            n = at[inner]
            at[inner] = np.where(points[inner, dim[n]] < value[n], left[n], right[n])
        return left[at]


class KDTree:
    """Median splits down to ``leaf`` points, with each node's bounding box."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 128):
        self.points, self.ids = points, ids
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, z, parent, side = todo.pop()
            node = len(self.span)
            if parent >= 0:
                pair = self.kids[parent] or (0, 0)
                self.kids[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            here = points[self.order[a:z]]
            lo, hi = here.min(0), here.max(0)
            low.append(lo)
            high.append(hi)
            self.span.append((a, z))
            self.kids.append(None)
            if z - a > leaf and points.shape[1] and (hi > lo).any():
                d = int((hi - lo).argmax())
                m = (z - a) // 2
                self.order[a:z] = self.order[a:z][np.argpartition(here[:, d], m)]
                todo += [(a, a + m, node, 0), (a + m, z, node, 1)]
        self.points, self.ids = points[self.order], ids[self.order]   # a leaf is a slice
        self.low, self.high = np.array(low), np.array(high)
        self.largest = float(np.abs(points).max(initial=0))

    def search(self, q: np.ndarray, k: int, bound: int | None = None, own: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) with score at least ``bound`` and another id than ``own``; ties go to smaller ids."""
        exact = self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT
        if exact:
            limit = self.high @ np.maximum(q, 0) + self.low @ np.minimum(q, 0)
            limit = limit.tolist()
        else:  # too large for doubles to be exact: whole numbers, and no node is skipped
            limit = [float("inf")] * len(self.span)
        best: list[tuple[int, int]] = []
        heap = [(-limit[0], 0)]
        while heap:
            minus, node = heapq.heappop(heap)
            if bound is not None and -minus < bound:
                break
            if (kids := self.kids[node]) is not None:
                for kid in kids:
                    if bound is None or limit[kid] >= bound:
                        heapq.heappush(heap, (-limit[kid], kid))
                continue
            a, z = self.span[node]
            ids, points = self.ids[a:z], self.points[a:z]
            if own is not None:
                others = ids != own
                ids, points = ids[others], points[others]
            if exact:
                scores = points @ q
                if bound is not None:
                    good = np.flatnonzero(scores >= bound)
                    ids, scores = ids[good], scores[good]
                    if not len(good):
                        continue
                found = zip(scores.astype(np.int64).tolist(), ids.tolist())
            else:
                whole = [int(x) for x in q]
                found = [(_clip(sum(int(x) * y for x, y in zip(p, whole))), i) for p, i in zip(points, ids.tolist())]
            best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                bound = best[-1][0]
        return best


def _points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.zeros((0, 0))


def _clip(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def _answers(tree: KDTree, asks: list[tuple[bytes, bytes, int | None, int | None]], k: int) -> list[tuple]:
    """HIT rows of the queries (vkey, vec, bound, own)."""
    rows = []
    for vkey, vec, bound, own in asks:
        rows += [(HIT, vkey, None, None, _clip(s), i, own) for s, i in tree.search(np.frombuffer(vec, "<f8"), k, bound, own)]
    return rows


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in FOUND]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)


# --- Spark side -----------------------------------------------------------------------------------------------------

def quantise(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec, vkey): floor(256 x) of each usable vector as little-endian doubles, which
    hold it exactly, and a 128-bit key of these bytes."""
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(256 * v.values.to_numpy(zero_copy_only=False).astype("<f8")) + 0.0
                if np.isfinite(x).all():
                    ids.append(i)
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], schema=schema)

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, vec binary").withColumn("vkey", F.unhex(F.md5("vec")))


def shard_trees(sample: list[bytes], rows_of_length: dict[int, int], shard_rows: int, max_shards: int) -> dict[int, Splits]:
    """A coarse tree for each vector length (in bytes), fitted on a bounded sample."""
    trees = {}
    for length, n in rows_of_length.items():
        mine = [s for s in sample if len(s) == length]
        points = np.frombuffer(b"".join(mine), "<f8").reshape(len(mine), length // 8)
        trees[length] = Splits.fit(points, max(1, min(max_shards, -(-n // shard_rows))))
    return trees


def _deal(frame: DataFrame, trees: dict[int, Splits]) -> DataFrame:
    """Adds ``shard``: vector length and leaf of its coarse tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            length = np.array([len(v) for v in raw], int)
            shard = np.zeros(len(raw), np.int64)
            for n in set(length.tolist()):
                at = np.flatnonzero(length == n)
                points = np.frombuffer(b"".join(raw[i] for i in at), "<f8").reshape(len(at), n // 8)
                shard[at] = (n << 20) + (trees[n].leaf_of(points) if n in trees else 0)
            yield batch.append_column("shard", pa.array(shard))

    return frame.mapInArrow(run, frame.schema.simpleString()[7:-1].replace(":", " ") + ", shard bigint")


def top_k(embeddings: DataFrame, k: int = 5, query_step: int = 50, shard_rows: int = 8192, max_shards: int = 4096,
          sample_rows: int = 8192, block_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``query_step``, the k best other rows.

    ``sample_rows`` bounds what the coarse tree is fitted on and ``max_shards``
    its leaves, so also the boxes that the driver gathers.
    """
    rows = cut(quantise(embeddings))
    smallest = Window.partitionBy("vkey").orderBy("vec_id")
    alike = rows.groupBy("vkey", "vec", "vec_id").agg(F.count(F.lit(1)).alias("_n"))
    alike = alike.select("vkey", "vec", "vec_id", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(k)).cast("int"))).alias("_copy"))
    points = cut(alike.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= 2 * k).select("vec_id", "vec", "vkey"))
    asking = rows.where(F.col("vec_id") % query_step == 0)
    repeated = asking.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("vec_id").alias("own"))
    # A row whose id other rows repeat searches on its own; the others drop their one row from the k + 1 best.
    queries = asking.join(repeated, asking.vec_id == F.col("own"), "left")
    # At most sample_rows vectors, and one count for each vector length.
    sample = [bytes(r.vec) for r in points.where("vec_id IS NOT NULL").orderBy(F.xxhash64("vec"), "vec_id").limit(sample_rows).select("vec").collect()]
    lengths = {r["n"]: r["rows"] for r in points.groupBy(F.octet_length("vec").alias("n")).agg(F.count("*").alias("rows")).collect()}
    trees = shard_trees(sample, lengths, shard_rows, max_shards)

    nothing = F.lit(None).cast("long")
    asked = queries.select("vkey", "vec", "own").distinct().select(nothing.alias("vec_id"), "vec", "vkey", "own")
    dealt = cut(_deal(points.select("vec_id", "vec", "vkey", nothing.alias("own")).unionAll(asked), trees))

    def home(group: pa.Table) -> pa.Table:
        is_point = group.column("vec_id").is_valid()
        mine = group.filter(is_point)
        tree = KDTree(_points(mine.column("vec")), mine.column("vec_id").to_numpy())
        asks = group.filter(pa.compute.invert(is_point))
        shard = group.column("shard")[0].as_py()
        rows = [(BOX, None, shard, tree.low[0].tobytes() + tree.high[0].tobytes(), None, None, None)] if mine.num_rows else []
        for vkey, vec, own in zip(*(asks.column(c).to_pylist() for c in ("vkey", "vec", "own"))):
            hits = _answers(tree, [(vkey, vec, None, own)], k + 1)
            rows += hits
            rows.append((ASK, vkey, shard, vec, hits[-1][4] if len(hits) > k else None, None, own))
        return _table(rows)

    near = cut(dealt.groupBy("shard").applyInArrow(home, FOUND_DDL))
    # One box a shard: at most max_shards for each vector length.
    boxes = {}
    for r in near.where(f"kind = {BOX}").select("shard", "vec").collect():
        low, high = np.frombuffer(bytes(r.vec), "<f8").reshape(2, -1)
        boxes.setdefault(8 * low.size, []).append((r.shard, low, high))
    boxes = {n: (np.array([s for s, _, _ in b]), np.stack([x for _, x, _ in b]), np.stack([x for _, _, x in b])) for n, b in boxes.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vkey, shard, vec, bound, own in zip(*(batch.column(c).to_pylist() for c in ("vkey", "shard", "vec", "score", "own"))):
                shards, low, high = boxes[len(vec)]
                q = np.frombuffer(vec, "<f8")
                reach = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
                slack = 1e-9 * (np.abs(high) @ np.abs(q) + np.abs(low) @ np.abs(q))
                go = shards if bound is None else shards[reach + slack >= bound]
                rows += [(ASK, vkey, s, vec, bound, None, own) for s in go.tolist() if s != shard]
            yield from _table(rows).to_batches()

    sent = cut(near.where(f"kind = {ASK}").mapInArrow(route, FOUND_DDL))
    most = sent.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // block_rows))
    asks = sent.withColumn("block", F.pmod(F.xxhash64("vkey"), F.lit(blocks)).cast("int"))
    spread = (dealt.where("vec_id IS NOT NULL").select("shard", "vec", "vec_id")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        tree = KDTree(_points(left.column("vec")), left.column("vec_id").to_numpy())
        asks = zip(*(right.column(c).to_pylist() for c in ("vkey", "vec", "score", "own")))
        return _table(_answers(tree, list(asks), k + 1))

    far = spread.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(visit, FOUND_DDL)
    best = Window.partitionBy("vkey", "own").orderBy(F.desc("score"), "vec_id")
    hits = (near.where(f"kind = {HIT}").unionAll(far).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
            .select("vkey", F.col("own").alias("_own"), "score", "vec_id"))
    pairs = (queries.select(F.col("vec_id").alias("query_id"), "vkey", "own").join(hits, "vkey")
             .where(F.col("own").eqNullSafe(F.col("_own")) & (F.col("query_id") != F.col("vec_id"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every row whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
