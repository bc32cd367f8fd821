"""Helpers shared by the operators: tables, lineage cuts, Arrow row building."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.session import ensure_checkpoint_dir


#: Bytes that cross to Python at once; rows count for less where texts differ a thousandfold in size.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python can import it,
    and bounds Arrow batches by bytes unless the session already does."""
    sc = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit).removesuffix("b") == str(64 << 20):     # Spark's default
        spark.conf.set(limit, str(BATCH_BYTES))
    if getattr(sc, "_parcela_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="parcela-")) / "parcela.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._parcela_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark's own file systems."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the files.

    The copy survives lost executors.  Spark removes the files when the frame
    is no longer referenced and ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is on.  The shuffles that led to the copy are not needed any more; Spark's
    cleaner deletes them as soon as the driver's garbage collection, which is asked
    for here, finds them unreferenced.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    del df                  # else its shuffles would stay until the next cut
    gc.collect()
    kept.sparkSession.sparkContext._jvm.System.gc()
    return kept


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def column_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of one column: what Python holds at once stays bounded."""
    sizes = batch.column(name).cast(pa.large_binary())
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(sizes).to_pylist()):
        held += n or 0
        if held > limit and i + 1 < batch.num_rows:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def to_batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Row tuples as one record batch of the given schema."""
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
