"""Quality classifier: regularised quadratic discriminant (operator 9).

Statistics of a whole text are transformed to a roughly even scale, each
class gets a mean and a covariance shrunk towards its own diagonal and the
pooled one, and a document's score is the logistic of the calibrated
difference of the two log-densities.  Densities come from Cholesky factors
that are made once, when the model is fitted.

The model is fitted on a bounded sample of labelled rows (``max_rows``)
outside the held-out quarter; only the texts are its inputs.  If a class is
missing, nothing can be told apart: every score is the share of good rows,
or 1 without any usable label.

Defined cases: a null or empty text is scored like any other by its (zero)
counts; a null ``doc_id`` is never learnt from nor held out; ids with
contradicting labels are not learnt from; repeated rows give their rows
again; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import chunks, column_bytes, held_out, table
from parcela.llm.textstats import BEGINS, DIGIT, LOWER, MARK, SPACE, SYMBOL, UPPER, TextBlock

THRESHOLD = 0.7
FEATURES = ("log_words", "word_length", "symbols", "marks", "upper", "digits", "distinct", "same_as_previous",
            "repeats", "dup_lines", "line_words", "symbol_lines", "upper_lines", "wide")


def statistics(block: TextBlock) -> np.ndarray:
    """(texts, features): transformed document statistics.

    Shares go through log(share + 0.01), counts through log(1 + count), so
    that classes come out roughly normal.
    """
    n, words = block.n, block.n_words
    some = np.maximum(words, 1)
    chars = np.maximum(block.word_chars, 1)
    letters = np.maximum(block.by_doc(UPPER | LOWER), 1)
    doc, code = block.word_doc, block.word_code
    base = int(code.max(initial=0)) + 1
    distinct = np.bincount(np.unique(doc * base + code) // base, minlength=n)
    same = np.bincount(doc[1:], (code[1:] == code[:-1]) & (doc[1:] == doc[:-1]), n) if len(doc) > 1 else np.zeros(n)
    lines = np.maximum(np.bincount(block.line_doc, block.line_words > 0, n), 1)
    line_chars = np.maximum(block.by_line(BEGINS & ~SPACE), 1)
    odd = np.bincount(block.line_doc, (block.by_line(SYMBOL) / line_chars > 0.05) * line_chars, n)
    loud = np.bincount(block.line_doc, (block.by_line(UPPER) / line_chars > 0.3) * line_chars, n)
    share = lambda x, of: np.log(x / of + 0.01)
    wide = np.ones(256, bool)
    wide[:128] = False
    return np.stack([
        np.log1p(words), np.log(chars / some + 0.5), share(block.by_doc(SYMBOL), some), share(block.by_doc(MARK), some),
        share(block.by_doc(UPPER), letters), share(block.by_doc(DIGIT), chars),
        np.log(distinct / some + 0.05) + 0.1 * np.log1p(words), share(same, some), share(block.n_repeat_words, some),
        share(block.n_dup_lines, lines), np.log1p(words / lines), share(odd, chars), share(loud, chars),
        share(block.by_doc(wide & BEGINS), chars)], 1)


@dataclass
class Discriminant:
    """Class means and inverse Cholesky factors on standardised features; ``slope`` and ``shift`` calibrate."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float
    shift: float
    constant: float | None = None

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-density of the good class less that of the other."""
        z = (x - self.centre) / self.scale
        density = [self.offsets[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratio(x) + self.shift, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, pool: float = 0.2, floor: float = 0.02) -> Discriminant:
    """``shrink`` moves each covariance towards its diagonal, ``pool`` towards the pooled one;
    ``floor`` is added to the variances of the standardised features."""
    p = x.shape[1]
    counts = np.bincount(y, minlength=2)
    blank = Discriminant(np.zeros(p), np.ones(p), np.zeros((2, p)), np.stack([np.eye(p)] * 2), np.zeros(2), 1.0, 0.0)
    if not counts.all():
        blank.constant = float(y.mean()) if len(y) else 1.0
        return blank
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    means = np.stack([z[y == k].mean(0) for k in (0, 1)])
    raw = [np.atleast_2d(np.cov(z[y == k], rowvar=False, bias=True)) for k in (0, 1)]
    pooled = (counts[0] * raw[0] + counts[1] * raw[1]) / counts.sum()
    factors, offsets = [], []
    for k in (0, 1):
        s = (1 - pool) * raw[k] + pool * pooled
        s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + floor * np.eye(p)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(lower)).sum())
    model = Discriminant(centre, scale, means, np.stack(factors), np.array(offsets), 1.0, 0.0)
    model.slope, model.shift = _calibrate(model.ratio(x), y)
    return model


def _calibrate(ratio: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the log-density difference (Newton, lightly penalised)."""
    spread = max(float(ratio.std()), 1e-9)
    r = np.stack([ratio / spread, np.ones_like(ratio)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(r @ w, -30, 30)))
        hessian = (r * (q * (1 - q))[:, None]).T @ r + np.diag([0.1, 0.01])
        change = np.linalg.solve(hessian, r.T @ (y - q) - np.array([0.1, 0.01]) * w)
        w = w + np.clip(change, -2, 2)
    return max(float(w[0]), 1e-3) / spread, float(w[1])


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Discriminant:
    """Fits the classes on up to ``max_rows`` labelled rows, the first by a hash of their ids."""
    chosen = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most"))
              .where("label = _most").select("doc_id", "label")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # At most max_rows pairs of id and label: a proven bound.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = statistics(TextBlock(column_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(list(x))], ["label", "x"])

    rows = sorted((r.label, r.x) for r in texts.mapInArrow(run, "label int, x array<double>").collect())
    x = np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[0] for r in rows], int))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = model.score(statistics(TextBlock(column_bytes(part.column("text")))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s),
                                                  pa.array((s >= threshold).astype(np.int32))], schema=SCHEMA)

    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    return inputs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the columns they came with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = model.score(statistics(TextBlock(column_bytes(part.column("text")))))
                yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
