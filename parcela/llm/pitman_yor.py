"""LM scoring: hierarchical Pitman-Yor model of word pairs (operator 11).

Every preceding word (and the start of a text) has a restaurant whose customers are the words that
follow it in training texts.  All of them share one parent, the root
restaurant: each table of a child sends one customer there.  The root's own
tables draw from the uniform distribution over the known tokens and one
unknown token.  With c customers and t tables for a word, C and T in all,
strength s and discount 1/2, a restaurant predicts
(c - t/2 + (s + T/2) * parent) / (s + C).

Seating is sampled by blocked Gibbs steps: all customers of one word in one
restaurant rise together and are seated anew given the rest.  Predictions
need only the number of their tables, and the seatings with t tables have the
joint weight S(c, t) * prod(s + T'/2) * parent**t over growing table counts T', where S is a
generalised Stirling number.  For discount 1/2 the ratios of neighbouring numbers have a
closed form, S(c, t + 1) / S(c, t) = 4 (c - t) / ((2c - t - 1) t), so that a
step costs about the spread of t, not c: a pair that holds a third of the
corpus is one cheap row.  Steps of a sweep run at once over all pairs, on the
table totals and parent predictions of the sweep before; the root follows.
Predictive probabilities are averaged over the ``samples`` sweeps after ``burn``.
The random numbers are hashes of (pair, sweep): results do not depend on the
partitioning.

How it runs.  Whole texts are tokenised once into blocks of about
``block_bytes`` with local word numbers.  Words get global numbers from a
distributed dictionary.  A block's distinct pairs go to buckets by context as
compressed sorted lists, so counts are added up before the shuffle; a frequent
context's pairs are dealt to more buckets.  Pairs met once have one
table for good and stay out of the sweeps.  For scoring, the blocks get back
the pairs' values and the words' parameters.  The driver sees counts only: buckets, words, tokens,
root tables.

Defined cases: a null or empty text is the end token alone.  A null id is
neither learnt from nor held out.  Rows that repeat an id are texts of
their own.  Without training texts every probability is 1.  An empty table
gives an empty result.  Further columns are passed by.  At most 2**32 - 2
distinct training words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import chunks, ship, table
from parcela.llm.shelf import Shelf
from parcela.operators.numbering import numbered

DISCOUNT = 0.5
#: No word holds white space, so a line feed can stand for the end of a text among the words.
END = "\n"
#: Number of the context before a text's first token; words are numbered from 1, unknown ones are -1.
START, UNKNOWN = 0, -1
#: Training count from which a context's pairs are dealt to a further bucket.
SPREAD = 1 << 16


# --- packed integers -------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Eight-byte numbers with equal bytes beside one another, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, dtype: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(dtype)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit function of 64-bit numbers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(u: np.ndarray, w: np.ndarray, sweep: int) -> np.ndarray:
    """A number in [0, 1) for each pair in a sweep."""
    with np.errstate(over="ignore"):
        key = mixed(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(sweep + 1)) + w.astype(np.uint64)
    return (mixed(key) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# --- seating -----------------------------------------------------------------------

def _odds(t, c, others, p, strength):
    """Weight of t + 1 tables over that of t, for c customers of one word."""
    return (strength + DISCOUNT * (others + t)) * p * 4 * (c - t) / ((2 * c - t - 1) * t)


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, uniform: np.ndarray) -> np.ndarray:
    """The number of tables of each word's c customers, given the restaurant's ``others`` and the parent's ``p``."""
    out = np.ones(len(c), np.int64)
    c, others = c.astype(np.float64), others.astype(np.float64)
    many = c > 1
    far = many & (c > 17) & (_odds(16.0, np.maximum(c, 18), others, p, strength) > 1)
    near = np.flatnonzero(many & ~far)
    # The weights fall from 16 tables on: walk up from one table.
    total = np.ones(len(near))
    live, weight, t = np.arange(len(near)), np.ones(len(near)), 1.0
    while len(live):
        i = near[live]
        weight = weight * _odds(t, c[i], others[i], p[i], strength)
        total[live] += weight
        t += 1
        on = (c[i] > t) & ((t < 16) | (weight > 1e-18 * total[live]))
        live, weight = live[on], weight[on]
    target = uniform[near] * total
    live, weight, t = np.arange(len(near)), np.ones(len(near)), 1.0
    upto = np.ones(len(near))
    while True:
        on = (target[live] >= upto[live]) & (c[near[live]] > t)
        live, weight = live[on], weight[on]
        if not len(live) or t > 10_000:
            break
        i = near[live]
        weight = weight * _odds(t, c[i], others[i], p[i], strength)
        upto[live] += weight
        t += 1
        out[i] = int(t)
    for i in np.flatnonzero(far):
        out[i] = _draw_far(c[i], others[i], p[i], strength, uniform[i])
    return out


def _draw_far(c: float, others: float, p: float, strength: float, uniform: float) -> int:
    """One draw about the most likely number of tables."""
    low, high = 1, int(c)
    while low < high:                               # the odds fall with t
        mid = (low + high) // 2
        if _odds(float(mid), c, others, p, strength) > 1:
            low = mid + 1
        else:
            high = mid
    width = 12 * int(low ** 0.5) + 40
    while True:
        a, z = max(1, low - width), min(int(c), low + width)
        t = np.arange(a, z + 1, dtype=np.float64)
        logs = np.concatenate([[0.0], np.cumsum(np.log(_odds(t[:-1], c, others, p, strength)))])
        logs -= logs.max()
        if (a == 1 or logs[0] < -45) and (z == int(c) or logs[-1] < -45):
            break
        width *= 2
    upto = np.cumsum(np.exp(logs))
    return a + int(np.searchsorted(upto, uniform * upto[-1], side="right").clip(0, len(upto) - 1))


# --- blocks of texts ---------------------------------------------------------------

BLOCK_DDL = "block long, doc_ids array<long>, learn array<boolean>, sizes array<int>, tokens binary, words array<string>, counts array<long>"
CODED_DDL = "block long, doc_ids array<long>, learn array<boolean>, sizes array<int>, tokens binary, ids binary, counts binary"


def held_out(doc_id):
    """Rows not learnt from: crc32 of the id's text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words lower-cased in A-Z, words a text); null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, at = lists.flatten(), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    # Folded after the filter, which copies: some Arrow releases fold a slice's wrong bytes.
    return pc.ascii_lower(words.filter(some)), np.diff(upto[at - at[0]])


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(block: int, parts: list[tuple]) -> pa.RecordBatch:
    """One block row: local word 0 is the end token, the others follow as met."""
    coded = pa.concat_arrays([words for _, _, words, _ in parts]).dictionary_encode()
    learn = np.concatenate([x for _, x, _, _ in parts])
    sizes = np.concatenate([n for _, _, _, n in parts]) + 1
    tokens = np.zeros(int(sizes.sum()), np.int64)
    plain = np.ones(len(tokens), bool)
    plain[np.cumsum(sizes) - 1] = False
    tokens[plain] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    counts = np.bincount(tokens[np.repeat(learn, sizes)], minlength=len(coded.dictionary) + 1)
    words = pa.concat_arrays([pa.array([END], pa.string()), coded.dictionary.cast(pa.string())])
    columns = {"block": pa.array([block]), "doc_ids": _one(pa.concat_arrays([d for d, _, _, _ in parts])), "learn": _one(pa.array(learn)),
               "sizes": _one(pa.array(sizes, pa.int32())), "tokens": pa.array([pack(tokens)], pa.binary()), "words": _one(words), "counts": _one(pa.array(counts, pa.int64()))}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The texts in blocks, each token a local word number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for part in chunks(batch):
                words, n = split_words(part.column("text"))
                parts.append((part.column("doc_id"), part.column("learn").to_numpy(zero_copy_only=False), words, n))
                held += part.column("text").nbytes
                if held >= block_bytes:
                    yield _block(block, parts)
                    block, held, parts = block + 1, 0, []
        if parts:
            yield _block(block, parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")), F.lit(False)).alias("learn"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK_DDL)


def number_words(blocks: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(dictionary of training words: word, id, c; the blocks with global word numbers and counts)."""
    vocabulary = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w"))
    vocabulary = vocabulary.select("block", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counted = vocabulary.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    words = shelf.put("dictionary", numbered(counted, [F.col("word")], "id").withColumn("id", F.col("id") + 1))
    known = vocabulary.select(F.col("block").alias("block"), "local", "word").join(words.hint("shuffle_hash"), "word").select("block", "local", "id", "c")

    def code(block: pa.Table, found: pa.Table) -> pa.Table:
        size = block.column("size")[0].as_py()
        ids, counts = np.full(size, UNKNOWN, np.int64), np.zeros(size, np.int64)
        at = found.column("local").to_numpy()
        ids[at], counts[at] = found.column("id").to_numpy(), found.column("c").to_numpy()
        return block.drop_columns(["size"]).append_column("ids", pa.array([pack(ids)], pa.binary())).append_column("counts", pa.array([pack(counts)], pa.binary()))

    bare = blocks.select(F.col("block").alias("block"), "doc_ids", "learn", "sizes", "tokens", F.size("words").alias("size"))
    coded = shelf.put("coded", bare.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(code, CODED_DDL))
    return words, coded


class Block:
    """One coded block: its pairs, and where they stand."""

    def __init__(self, row: dict) -> None:
        self.block, self.doc_ids = row["block"], row["doc_ids"]
        self.learn, self.sizes = np.array(row["learn"], bool), np.array(row["sizes"], np.int64)
        self.tokens, self.ids, self.counts = unpack(row["tokens"]), unpack(row["ids"]), unpack(row["counts"])
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.first] = -1
        self.before = before                        # local number of the word before; -1 at a text's start

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        """(the tokens whose word and context are training words, their pairs as one number each)."""
        w = self.ids[self.tokens]
        u = np.where(self.before < 0, START, self.ids[self.before])
        at = np.flatnonzero((w > 0) & (u >= 0))
        return at, (u[at].astype(np.uint64) << np.uint64(32)) | w[at].astype(np.uint64)

    def _buckets(self, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(order of ascending ``keys`` by bucket, bucket bounds).

        A context's pairs go to one bucket, those of a frequent one to as many as its count fills.
        """
        u, w = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        known = np.flatnonzero(self.ids > 0)
        ids = np.concatenate([[START], self.ids[known]])
        counts = np.concatenate([[self.counts[0]], self.counts[known]])     # as many texts start as end
        by_id = np.argsort(ids)
        c = counts[by_id][np.searchsorted(ids[by_id], u.astype(np.int64))]
        spread = (c // SPREAD + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            bucket = mixed(mixed(u) + np.where(spread > 1, mixed(w) % spread, 0).astype(np.uint64)) % np.uint64(buckets)
        bucket = bucket.astype(np.uint16 if buckets <= 65536 else np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def counted(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs by bucket and value, their training counts, bucket bounds)."""
        at, keys = self._known()
        learnt, n = _distinct(np.sort(keys[np.repeat(self.learn, self.sizes)[at]]))
        keys, _ = _distinct(np.sort(keys))
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, learnt)] = n
        order, bounds = self._buckets(keys, buckets)
        return keys[order], counts[order], bounds

    def placed(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the tokens in known pairs, the places of their pairs in ``counted``, bucket bounds)."""
        at, keys = self._known()
        keys, of = np.unique(keys, return_inverse=True)
        order, bounds = self._buckets(keys, buckets)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return at, place[of], bounds


def _distinct(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, np.int64)
    return ascending[first], np.diff(np.append(first, len(ascending)))


def messages(coded: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, keys, n): each block's distinct pairs of known words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n, bounds = Block(row).counted(buckets)
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = slice(bounds[b], bounds[b + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["block"]], pa.int64()),
                                                      pa.array([pack(np.diff(keys[mine], prepend=np.uint64(0)))], pa.binary()),
                                                      pa.array([pack(n[mine])], pa.binary())], ["bucket", "block", "keys", "n"])

    return coded.mapInArrow(run, "bucket int, block long, keys binary, n binary")


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _merged(lists: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(lists)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


COUNTED_DDL = "bucket int, u long, w long, c long, once long"


def count_pairs(sent: DataFrame) -> DataFrame:
    """(bucket, u, w, c, once): the training count of every pair met twice or more; and for a context
    u (w null) and a word w (u null) how many pairs of a bucket have it, and how many of these were met once."""

    def ends(values: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some, of, n = np.unique(values, return_inverse=True, return_counts=True)
        return some.astype(np.int64), n, np.bincount(of, single, len(some)).astype(np.int64)

    def run(group: pa.Table) -> pa.Table:
        keys, c = _merged([_keys(k) for k in group.column("keys").to_pylist()], [unpack(n) for n in group.column("n").to_pylist()])
        keys, c = keys[c > 0], c[c > 0]
        u, w = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        many = c > 1
        contexts, words = ends(u, ~many), ends(w, ~many)
        sizes = [int(many.sum()), len(contexts[0]), len(words[0])]
        nulls = [pa.nulls(n, pa.int64()) for n in sizes]
        column = lambda a, b, d: pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in (a, b, d)])
        return pa.table({"bucket": pa.array(np.full(sum(sizes), group.column("bucket")[0].as_py()), pa.int32()),
                         "u": column(u[many], contexts[0], nulls[2]), "w": column(w[many], nulls[1], words[0]),
                         "c": column(c[many], contexts[1], words[1]), "once": column(nulls[0], contexts[2], words[2])})

    return sent.groupBy("bucket").applyInArrow(run, COUNTED_DDL)


# --- sampling ----------------------------------------------------------------------

def _arrow_draw(frame: DataFrame, columns: list[str], strength: float, sweep: int, keep: list[str]) -> DataFrame:
    """``keep`` and the new ``t`` from columns (u, w, c, t, total, p) under the given names."""
    u, w, c, t, total, p = columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in columns}
            new = draw_tables(get[c], get[total] - get[t], get[p], strength, uniforms(get[u], get[w], sweep))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(new, pa.int64())], [*keep, "t"])

    types = dict(frame.dtypes)
    return frame.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keep) + ", t long")


@dataclass
class PitmanYor:
    """Sampled state: pair values (bucket, u, w, m), word parameters (id, l0.., p0..), and numbers."""

    shelf: Shelf
    pairs: DataFrame
    words: DataFrame
    coded: DataFrame
    buckets: int
    n_tokens: int
    n_words: int
    texts: int
    strength: float
    start: list[float]          # share of the root's prediction after a text's start, a sample each
    unknown: list[float]        # the root's prediction of an unknown word, a sample each


def _seat_root(words: DataFrame, shelf: Shelf, name: str, tables: int, strength: float, base: float, sweep: int) -> tuple[DataFrame, int, float]:
    """Root tables drawn anew; (words with t1 and p, the root's tables, its prediction of an unknown word)."""
    ready = words.withColumns({"u": F.lit(-1).cast("long"), "total": F.lit(tables).cast("long"), "base": F.lit(base)})
    keep = ["id", "c", "s_ctx", "s_wrd", "tables", "c1"]
    drawn = _arrow_draw(ready, ["u", "id", "c1", "t1", "total", "base"], strength, sweep, keep)
    drawn = shelf.put(name + "_drawn", drawn.withColumn("t1", F.when(F.col("c1") > 0, F.col("t")).otherwise(0)).drop("t"))
    sums = drawn.agg(F.sum("t1").alias("t"), F.sum("c1").alias("c")).first()
    tables, customers = sums.t or 0, sums.c or 0
    unknown = (strength + DISCOUNT * tables) * base / (strength + customers)
    return drawn.withColumn("p", (F.col("c1") - DISCOUNT * F.col("t1")) / (strength + customers) + F.lit(unknown)), tables, unknown


def learn(docs: DataFrame, strength: float = 2.0, root_strength: float = 2.0, burn: int = 1, samples: int = 2,
          block_bytes: int = 24 << 20, bucket_pairs: int = 1_000_000) -> PitmanYor:
    """Counts of all training texts and ``burn`` + ``samples`` sweeps; the texts stay at hand, coded, for ``score``."""
    spark = docs.sparkSession
    ship(spark)
    shelf = Shelf(spark, "pitman-yor")
    words, coded = number_words(shelf.put("blocks", blocks_of(docs, block_bytes)), shelf)
    shelf.drop("blocks")
    sums = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == END, F.col("c"))).alias("texts")).first()
    n_tokens, n_words, texts = sums.n or 0, sums.v, sums.texts or 0
    if n_words >= (1 << 32) - 1:
        raise ValueError(f"{n_words} distinct words: a pair of them does not fit 64 bits")
    spread = coded.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first().n or 0
    buckets = max(1, -(-spread // bucket_pairs))

    counted = shelf.put("counted", count_pairs(messages(coded, buckets)))
    contexts = counted.where("w IS NULL").groupBy(F.col("u").alias("id")).agg(F.sum("once").alias("s_ctx"), F.sum("c").alias("tables"))
    followers = counted.where("u IS NULL").groupBy(F.col("w").alias("id")).agg(F.sum("once").alias("s_wrd"), F.sum("c").alias("c1"))
    state = words.select("id", "c").unionByName(spark.range(1).select(F.lit(START).cast("long").alias("id"), F.lit(texts).cast("long").alias("c")))
    state = state.join(contexts.hint("shuffle_hash"), "id", "left").join(followers.hint("shuffle_hash"), "id", "left").na.fill(0)
    state = shelf.put("state", state.withColumn("t1", F.when(F.col("c1") > 0, 1).otherwise(0).cast("long")))
    many = (counted.where("u IS NOT NULL AND w IS NOT NULL")
            .select("bucket", "u", "w", "c", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("t_sum")))
    shelf.drop("dictionary")

    base = 1 / (n_words + 1)
    now, tables, unknown = _seat_root(state, shelf, "state0", n_words, root_strength, base, 0)
    shelf.drop("state")
    old, kept, start, unknowns = "state0_drawn", [], [], []
    for sweep in range(1, burn + samples + 1):
        # One row a word on the hashed side: it grows with the vocabulary over the partitions, not with hot pairs.
        looked = (many.join(now.select(F.col("id").alias("u"), F.col("tables").alias("total")).hint("shuffle_hash"), "u")
                  .join(now.select(F.col("id").alias("w"), "p").hint("shuffle_hash"), "w"))
        drawn = _arrow_draw(looked, ["u", "w", "c", "t", "total", "p"], strength, sweep, ["bucket", "u", "w", "c", "t_sum"])
        if sweep > burn:
            drawn = drawn.withColumn("t_sum", F.col("t_sum") + F.col("t"))
        many = shelf.put(f"many{sweep}", drawn)
        shelf.drop("counted" if sweep == 1 else f"many{sweep - 1}")
        by_context = many.groupBy(F.col("u").alias("id")).agg(F.sum("t").alias("t_ctx"))
        by_word = many.groupBy(F.col("w").alias("id")).agg(F.sum("t").alias("t_wrd"))
        state = (now.select("id", "c", "s_ctx", "s_wrd", "t1").join(by_context.hint("shuffle_hash"), "id", "left")
                 .join(by_word.hint("shuffle_hash"), "id", "left").na.fill(0)
                 .withColumns({"tables": F.col("s_ctx") + F.col("t_ctx"), "c1": F.col("s_wrd") + F.col("t_wrd")}))
        now, tables, unknown = _seat_root(state, shelf, f"state{sweep}", tables, root_strength, base, sweep)
        if sweep <= burn + 1:
            shelf.drop(old)
        old = f"state{sweep}_drawn"
        if sweep > burn:
            kept.append(now.select("id", ((strength + DISCOUNT * F.col("tables")) / (strength + F.col("c"))).alias(f"l{len(kept)}"), F.col("p").alias(f"p{len(kept)}")))
            start.append(now.where(F.col("id") == START).select((strength + DISCOUNT * F.col("tables")) / (strength + F.col("c"))).first()[0])
            unknowns.append(unknown)
    params = kept[0]
    for more in kept[1:]:
        params = params.join(more.hint("shuffle_hash"), "id")
    means = many.select("bucket", "u", "w", (F.col("c") - DISCOUNT * F.col("t_sum") / samples).alias("m"))
    return PitmanYor(shelf, means, params, coded, buckets, n_tokens, n_words, texts, strength, start, unknowns)


# --- scoring -----------------------------------------------------------------------

def _replies(model: PitmanYor) -> DataFrame:
    """(block, bucket, m): discounted counts of each message's pairs, in its order; 0 for pairs never met in training."""
    def answer(sent: pa.Table, found: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "m": pa.array([], pa.binary())})
        lists = [_keys(k) for k in sent.column("keys").to_pylist()]
        keys, c = _merged(lists, [unpack(n) for n in sent.column("n").to_pylist()])
        m = np.where(c == 1, 1 - DISCOUNT, 0.0)
        key = (found.column("u").to_numpy().astype(np.uint64) << np.uint64(32)) | found.column("w").to_numpy().astype(np.uint64)
        m[np.searchsorted(keys, key)] = found.column("m").to_numpy()
        return pa.table({"block": sent.column("block"), "bucket": sent.column("bucket"),
                         "m": pa.array([pack(m[np.searchsorted(keys, k)]) for k in lists], pa.binary())})

    return messages(model.coded, model.buckets).groupBy("bucket").cogroup(model.pairs.groupBy("bucket")).applyInArrow(answer, "block long, bucket int, m binary")


def score(model: PitmanYor) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text that ``learn`` was given."""
    buckets, strength, samples, texts = model.buckets, model.strength, len(model.start), model.texts
    n_tokens, n_words, start, unknown = model.n_tokens, model.n_words, np.array(model.start), np.array(model.unknown)
    params = [f"{x}{s}" for x in "lp" for s in range(samples)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist()):
                ids = unpack(data)
                at = np.flatnonzero(ids > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(ids[at])], ["block", "local", "id"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = Block(row)
        at, place, bounds = b.placed(buckets)
        values = np.zeros(int(bounds[-1]))
        for reply in row["replies"] or []:
            values[bounds[reply["bucket"]]:bounds[reply["bucket"] + 1]] = unpack(reply["m"], np.float64)
        first, where = b.before < 0, right.column("local").to_numpy()
        prob = np.zeros(len(b.tokens))
        for s in range(samples):
            share, root = np.ones(len(b.ids)), np.full(len(b.ids), unknown[s])
            share[where], root[where] = right.column(f"l{s}").to_numpy(), right.column(f"p{s}").to_numpy()
            prob += np.where(first, start[s], share[b.before]) * root[b.tokens]
        prob /= samples
        customers = np.where(first, texts, b.counts[b.before])
        prob[at] += values[place] / (strength + customers[at])
        c = b.counts[b.tokens]
        by_text = lambda x: np.add.reduceat(x, b.first)
        return pa.table({"doc_id": pa.array(b.doc_ids, pa.int64()), "n_tokens": pa.array(b.sizes), "n_known": pa.array(by_text((c > 0).astype(np.int64))),
                         "base_score": pa.array(by_text(np.log10((c + 1) / (n_tokens + 1 * (n_words + 1))))),
                         "score": pa.array(by_text(np.log10(prob)))})

    # Written before the next shuffles start, so that those of the messages are gone by then.
    answers = model.shelf.put("replies", _replies(model)).groupBy("block").agg(F.collect_list(F.struct("bucket", "m")).alias("replies"))
    whole = model.coded.join(answers, "block", "left")
    local_params = model.coded.select("block", "ids").mapInArrow(local, "block long, local int, id long").join(model.words.hint("shuffle_hash"), "id").select("block", "local", *params)
    out = whole.groupBy("block").cogroup(local_params.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probability of every document."""
    return score(learn(table(spark, sf_dir, "documents")))
