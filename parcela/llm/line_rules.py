"""Quality rules by line sequence labelling (operator 10).

Base rules count words, symbols, repeated lines and repeated word windows of
a whole text.  A linear-chain conditional random field then labels every line
as content or boilerplate, Viterbi finds the best labelling, and the share of
a document's word characters that lie in content lines decides whether it
stays.

The field is fitted on whole documents of a bounded sample of labelled rows
(``max_rows``): lines of documents marked good count as content, lines of the
others as boilerplate.  Without usable labels every weight is zero and all
lines are content.

Defined cases: a null or empty text has no words and fails the base rules; a
null ``doc_id`` stays null and is never learnt from; repeated rows give
their rows again; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import crf
from parcela.llm.common import chunks, column_bytes, held_out, table
from parcela.llm.textstats import BEGINS, DIGIT, LOWER, MARK, SPACE, SYMBOL, UPPER, TextBlock

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5

#: Upper edges of the bins of each numeric line statistic.
BINS = {
    "symbols_per_word": (0.0, 0.05, 0.2, 0.5),
    "marks_per_word": (0.0, 0.1, 0.3, 0.8, 1.5),
    "upper_share": (0.02, 0.1, 0.3, 0.7),
    "digit_share": (0.0, 0.05, 0.2),
    "distinct_share": (0.15, 0.3, 0.5, 0.7, 0.9),
    "same_as_previous": (0.0, 0.1, 0.5),
    "words": (0, 2, 5, 10, 30, 100),
    "word_length": (2, 3, 4, 5, 6, 8, 12),
}
FLAGS = ("repeats", "first", "last", "ends_sentence")
SIZES = [len(v) + 1 for v in BINS.values()] + [2] * len(FLAGS)
BASE = np.concatenate(([0], np.cumsum(SIZES)))
N_FEATURES = int(BASE[-1])


def line_features(block: TextBlock) -> np.ndarray:
    """(lines, k) indicator numbers, one for each statistic."""
    words = block.line_words
    some = np.maximum(words, 1)
    letters = np.maximum(block.by_line(UPPER | LOWER), 1)
    chars = block.by_line(BEGINS & ~SPACE)
    line, code = block.word_line, block.word_code
    pairs = np.unique(line * (int(code.max(initial=0)) + 1) + code)
    distinct = np.bincount(pairs // (int(code.max(initial=0)) + 1), minlength=len(words))
    same = np.bincount(line[1:], (code[1:] == code[:-1]) & (line[1:] == line[:-1]), len(words)) if len(line) > 1 else 0 * words
    values = {
        "symbols_per_word": block.by_line(SYMBOL) / some, "marks_per_word": block.by_line(MARK) / some,
        "upper_share": block.by_line(UPPER) / letters, "digit_share": block.by_line(DIGIT) / np.maximum(chars, 1),
        "distinct_share": distinct / some, "same_as_previous": same / some, "words": words, "word_length": chars / some,
    }
    columns = [np.searchsorted(BINS[k], v, "left") for k, v in values.items()]
    doc = block.line_doc
    last_byte = block.data[np.maximum(block.line_end - 2, 0)]
    columns += [block.line_repeats, np.diff(doc, prepend=-1) > 0, np.diff(doc, append=block.n) > 0, np.isin(last_byte, list(b".!?"))]
    return np.stack([c.astype(np.int64) + b for c, b in zip(columns, BASE)], 1)


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = 3000) -> crf.LinearChain:
    """Fits the field on up to ``max_rows`` labelled documents outside the held-out quarter,
    the first by a hash of their ids.  Ids with contradicting labels are left out."""
    chosen = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most"))
              .where("label = _most").select("doc_id", "label")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # At most max_rows pairs of id and label: a proven bound.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                block = TextBlock(column_bytes(part.column("text")))
                feats = line_features(block).astype(np.int16)
                ends = np.cumsum(np.bincount(block.line_doc, minlength=block.n))
                raw = [f.tobytes() for f in np.split(feats, ends[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(raw, pa.binary())], ["label", "feats"])

    rows = texts.mapInArrow(run, "label int, feats binary").collect()
    pairs = sorted((bytes(r.feats), r.label) for r in rows)  # whatever order the tasks came in
    sequences = []
    for raw, label in pairs:
        f = np.frombuffer(raw, np.int16).reshape(-1, len(SIZES)).astype(np.int64)
        sequences.append((f, np.full(len(f), label)))
    return crf.train(sequences, N_FEATURES)


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                   + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()),
                      ("content_lines", pa.list_(pa.bool_()))])
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, content_share double, content_lines array<boolean>")


def judge_block(block: TextBlock, model: crf.LinearChain) -> list[pa.Array]:
    """The columns after ``doc_id`` for every text of a block."""
    n_words, repeats = block.n_words, block.n_repeat_words
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    emissions = model.weights[line_features(block)].sum(1)
    ends = np.cumsum(np.bincount(block.line_doc, minlength=block.n)).tolist()
    content = np.fromiter((y for a, b in zip([0, *ends], ends) for y in model.decode(emissions[a:b])), bool, len(emissions))
    chars = block.by_line(BEGINS & ~SPACE)
    share = np.bincount(block.line_doc, chars * content, block.n) / np.maximum(block.word_chars, 1)
    lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(content))
    return [*(pa.array(x.astype(np.int64)) for x in (n_words, block.word_chars, block.by_doc(SYMBOL), block.n_dup_lines, repeats)),
            pa.array(failed), pa.array(~failed & (share >= MIN_CONTENT_SHARE)), pa.array(share), lists]


def judge(docs: DataFrame, model: crf.LinearChain) -> DataFrame:
    """Counts, verdict, content share and the label of each line, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                block = TextBlock(column_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *judge_block(block, model)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, DDL)


def keep_good(docs: DataFrame, model: crf.LinearChain) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                block = TextBlock(column_bytes(part.column("text")))
                yield part.filter(judge_block(block, model)[6])

    return docs.mapInArrow(run, schema)


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    rows = judge(docs, learn(docs, table(spark, sf_dir, "labels")))
    return rows.drop("content_lines")
