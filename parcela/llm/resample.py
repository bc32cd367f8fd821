"""Target-distribution importance resampling (operator 13).

Texts become word n-grams by byte work alone: a 256-byte table lower-cases
A-Z and blanks every separator of the UTF-8 text, ``bytes.split`` yields the
words, and a chained ``zlib.crc32`` extends an n-gram by a word without
building the n-gram.  Counters reduce the features of a task to its buckets'
counts before anything is shuffled.  A document's weight is the floored mean
of its features' log-ratios between target and corpus; adding Gumbel noise
that is a hash of the id and taking the highest draws without replacement in
proportion to the weights.

Counts cover all documents and all target texts.  What the driver holds are
the buckets' counts and gains (``buckets`` is a parameter) and two numbers of
the draw; ranks are given over range partitions.

Defined cases: a null or empty text, and one of separators only, has no
words, weight 0, and is never drawn while ``min_words`` is above 0.  A null
id is hashed as the empty text and comes last among ties; repeated rows are
documents of their own and rank next to each other.  Without documents the
result is empty; without target texts every gain follows from the corpus
alone.  Further columns are passed by.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.llm.common import chunks, column_bytes, cut, ship, table
from parcela.operators.numbering import numbered

#: Digits, letters and every byte of a wider character stay; A-Z become a-z; the rest separates words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text whose words are held as objects at once.
PIECE = 1 << 20
#: Distinct words or features kept in memory by a task before they are reduced.
DISTINCT = 500_000


def word_lists(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``piece`` bytes."""
    data = data.translate(TABLE)
    start = 0
    while len(data) - start > piece:
        end = data.find(b" ", start + piece)
        if end < 0:
            break
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def feature_counts(data: bytes, n: int = 1, piece: int = PIECE) -> Iterator[tuple[int, Counter]]:
    """(words, crc32 of each feature with its count) for each stretch of a text.

    Features are the runs of 1 to ``n`` consecutive words, joined by one space.
    """
    before: list[bytes] = []
    for words in word_lists(data, piece):
        if n == 1:
            yield len(words), _crcs(Counter(words))
            continue
        run = before + words
        found: Counter = Counter()
        for start in range(len(run)):
            seed = 0
            for k in range(start, min(start + n, len(run))):
                seed = crc32(run[k], crc32(b" ", seed) if k > start else 0)
                if k >= len(before):            # earlier ends were counted with the stretch before
                    found[seed] += 1
        yield len(words), found
        before = run[len(run) - n + 1:] if len(run) >= n else run


def _crcs(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, c in words.items():
        out[crc32(w)] += c
    return out


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features a bucket over all rows of ``texts`` (text): each task sends its buckets' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        held: Counter = Counter()

        def reduce() -> None:
            if held:
                at = np.fromiter(held.keys(), np.int64, len(held)) % buckets
                np.add.at(counts, at, np.fromiter(held.values(), np.int64, len(held)))
                held.clear()

        for batch in batches:
            for part in chunks(batch):
                for text in column_bytes(part.column("text")):
                    for _, found in feature_counts(text, n):
                        held.update(found)
                        if len(held) > DISTINCT:
                            reduce()
        reduce()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    sums = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():                    # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + b) / ((float(x) + 1) * (t + b)))) for x, y in zip(corpus, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor of 1000 times a Gumbel variate hashed from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gains(dict):
    """Gain of a feature by its crc32, remembered."""

    def __init__(self, table: list[int]) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, crc: int) -> int:
        if len(self) > DISTINCT:
            self.clear()
        out = self[crc] = self.table[crc % len(self.table)]
        return out


@dataclass
class Importance:
    """Gains of the feature buckets; features are runs of 1 to ``n`` words."""

    table: np.ndarray
    n: int = 1

    def weigh(self, docs: DataFrame, seed: int = 2024) -> DataFrame:
        """(doc_id, n_words, n_features, weight, score) of every row."""
        gains_of, n = self.table.tolist(), self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Gains(gains_of)
            for batch in batches:
                for part in chunks(batch):
                    rows = []
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), column_bytes(part.column("text"))):
                        words = features = total = 0
                        for w, found in feature_counts(text, n):
                            words += w
                            features += sum(found.values())
                            total += sum([known[f] * c for f, c in found.items()])
                        weight = total // features if features else 0
                        rows.append((doc_id, words, features, weight, weight + noise(doc_id, seed)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                     ["doc_id", "n_words", "n_features", "weight", "score"])

        ship(docs.sparkSession)
        inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return inputs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def learn(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> Importance:
    """Gains from the features of all ``documents`` and all ``target`` texts."""
    ship(documents.sparkSession)
    return Importance(gains(bucket_counts(documents, n, buckets), bucket_counts(target, n, buckets)), n)


def draw(weighed: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3... for the drawn ``percent`` of the rows of ``min_words`` words.

    The highest scores are drawn, ties to the smaller id.  A grouped count of
    the integer scores tells the lowest score drawn; only rows from there up
    are ordered.
    """
    rows = cut(weighed)
    enough = rows.where(F.col("n_words") >= min_words)
    by_score = enough.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Scores are integers between floors of logarithms: some ten thousands of values however many rows.
    above = Window.orderBy(F.desc("score"))
    stats = by_score.select("score", F.sum("n").over(above).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    found = stats.agg(F.max("total").alias("total"), F.max(F.when(F.col("upto") >= F.floor(F.col("total") * percent / 100), F.col("score"))).alias("least")).first()
    drawn = (found.total or 0) * percent // 100
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    chance = F.coalesce((F.col("n_words") >= min_words) & (F.col("score") >= found.least), F.lit(False))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    ranked = numbered(rows.where(chance), order, "place").withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return ranked.unionByName(rows.where(~chance).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's texts."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "benchmark"), n=1, buckets=10_000)
    return draw(model.weigh(docs)).select("doc_id", "n_features", "weight", "score", "rank")
