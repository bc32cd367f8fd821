"""Token counts by offset-mapped attribution (operator 7).

A document is encoded once as a whole.  Its tokens have byte extents (their
lengths add up to the text), and so have its sections: ``text`` is split at
line feeds, each line feed belonging to the line it ends.  The two interval
lists are merged; a token that lies in several sections is counted by an
explicit rule:

* ``first``: in the section that holds its first byte;
* ``most``: in the section that holds most of its bytes (a tie: the earlier).

Defined cases: a null or empty text is one section without tokens; a null
``doc_id`` stays null; repeated rows give their rows again; other columns are
left unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import chunks, column_bytes, table
from parcela.llm.fragments import encoder

VOCABULARY = "byte_bpe_50k.json"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("start_byte", pa.int64()),
                    ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
DDL = "doc_id long, section long, start_byte long, n_bytes long, n_tokens long, n_crossing long"


def line_ends(data: bytes) -> np.ndarray:
    """Ends of a text's sections: after each line feed, and at the end."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b == 10) + 1
    return ends if len(ends) and ends[-1] == len(b) and len(b) else np.append(ends, len(b))


def attribute(token_lengths: np.ndarray, ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of these reach over its end or start."""
    stop = np.cumsum(token_lengths)
    start = stop - token_lengths
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, stop - 1, "right")
    owner = first.copy()
    crossing = first != last
    if rule == "most":
        for i in np.flatnonzero(crossing):
            edges = np.concatenate(([start[i]], ends[first[i]:last[i]], [stop[i]]))
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    elif rule != "first":
        raise ValueError(f"unknown rule {rule!r}")
    n = len(ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """(doc_id, section, start_byte, n_bytes, n_tokens, n_crossing), one row a section.

    The section counts of a document add up to its token count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in chunks(batch):
                texts = column_bytes(part.column("text"))
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                doc_rows = []
                for data, ids in zip(texts, bpe.encode_many(texts)):
                    ends = line_ends(data)
                    lengths = bpe.token_length[np.frombuffer(ids, "<u4")]
                    tokens, crossing = attribute(lengths, ends, rule)
                    starts = np.concatenate(([0], ends[:-1]))
                    doc_rows.append(len(ends))
                    for c, x in zip(cols, (np.arange(len(ends)), starts, ends - starts, tokens, crossing)):
                        c.append(x)
                doc_ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(doc_rows)), doc_rows)))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, DDL)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every section of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
