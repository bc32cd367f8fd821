"""Sources and sinks: CSV scans with declared schemas, the CSV sink and rows ->
DataFrame (S1-S4).  Fitted models are saved and read by ``models.PriceModel``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from parcela.schema import CLEAN, RAW


def read_raw_csv(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """Raw listings, header row, every column text (no inference)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_clean_csv(spark: SparkSession, path: str, schema: StructType = CLEAN) -> DataFrame:
    """Clean listings with the declared typed schema; the path is a parameter."""
    return spark.read.schema(schema).option("header", True).csv(path)


def rows_to_frame(spark: SparkSession, rows: Iterable, schema: StructType) -> DataFrame:
    """S3: small driver-side rows (e.g. valuation requests) with a declared schema."""
    return spark.createDataFrame(list(rows), schema=schema)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header, overwrite.  ``single_file`` funnels all rows into
    one task and is only for small outputs."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
