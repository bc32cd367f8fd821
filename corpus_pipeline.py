"""Corpus pipeline: five stages from ``documents`` to packed training sequences.

Every stage is a function of (spark, docs, sf_dir) and works on all rows that
the stage before kept; ``run`` writes each result as Parquet to the shared
checkpoint folder and reads it back as the next stage's input, so a stage
lost with its executors starts from files.  All stages but the last return
the columns of ``documents``.

Rows with a null ``doc_id`` pass through filters like others and are no one's
near duplicate; null texts fail the quality rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import jaccard, line_dedup, line_rules, packing, qda
from parcela.llm.common import ship, table
from parcela.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates share 80 % of their distinct five-word shingles.
SHINGLE_WORDS, SIMILAR = 5, (80, 100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    model = line_rules.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return line_rules.keep_good(docs.select(*COLUMNS), model)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores at its threshold or above."""
    model = qda.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return qda.keep_good(docs.select(*COLUMNS), model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them hold; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS), carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows that repeat both id and text are one document and stay together.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    rows = jaccard.join_components(docs, SHINGLE_WORDS, *SIMILAR)
    gone = rows.where("component_id < doc_id").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(gone.hint("shuffle_hash"), (docs.doc_id == F.col("_id")) & (version == F.col("_version")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates),
    ("packing", pack),
]

#: Models and packing have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last.

    A stage's files are removed once the next stage is written; the last
    stage's files are the result and stay.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs
