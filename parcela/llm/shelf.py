"""Tables between the steps of one job, in the shared checkpoint folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from parcela.session import ensure_checkpoint_dir


class Shelf:
    """Parquet tables of one job: written once, read by later steps, removed when their last reader has run.

    A step that loses its executors starts again from the files of the steps
    before.  Tables that the caller's result still reads are not removed.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        # The shuffles and checkpoints behind a frame that the caller does not keep have no reader left:
        # let Spark's cleaner find that now, not one step later.
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)
