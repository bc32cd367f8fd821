"""BPE encoding and decoding by forced-boundary splitting (operator 8).

Defined cases: a null text is the empty text; the empty text has no ids; a
null ``doc_id`` stays null; repeated rows each give a row; other columns are
left unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import chunks, column_bytes, table, to_batch
from parcela.llm.fragments import encoder

VOCABULARY = "byte_bpe_50k.json"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of each whole text as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in chunks(batch):
                ids = bpe.encode_many(column_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], schema=schema)

    return _inputs(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of frames that ``encode`` returns."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in chunks(batch, "ids"):
                rows = zip(part.column("doc_id").to_pylist(), column_bytes(part.column("ids")))
                yield to_batch([(d, bpe.decode(np.frombuffer(i, "<u4")).decode()) for d, i in rows], schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_decode_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids and decoded text of each document as digests, in one pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for d, ids in zip(part.column("doc_id").to_pylist(), bpe.encode_many(column_bytes(part.column("text")))):
                    text = bpe.decode(np.frombuffer(ids, "<u4"))
                    rows.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
                yield to_batch(rows, schema)

    return _inputs(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, ids digest and decoded digest of every document."""
    return encode_decode_digests(table(spark, sf_dir, "documents"))
