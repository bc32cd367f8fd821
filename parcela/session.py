"""Session factory and the shared checkpoint folder.

Adaptive execution is on (runtime coalescing, skew-join splitting and
broadcast conversion from measured sizes), the web UI is off.  Checkpoints go
to the folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "Asia/Ho_Chi_Minh",
    # HotSpot does not JIT-compile methods over 8000 bytes of bytecode; a
    # whole-stage method above that runs interpreted.  Spark's documented
    # advice for HotSpot is to fall back to per-operator codegen instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(app_name: str = "parcela", master: str | None = None,
                conf: dict[str, str] | None = None,
                enable_hive: bool = False) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults plus ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    if enable_hive:
        builder = builder.enableHiveSupport()
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, registered with the context.

    It is the one ``spark.checkpoint.dir`` names.  Where the setting is
    absent, a folder beside the warehouse serves: the warehouse is shared by
    definition, a machine's own temp folder is not.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def compiled_methods(spark: SparkSession) -> None:
    """Holds generated methods to what HotSpot compiles, in a session that others have made, too.

    Deriving and cleaning in one whole-stage method is above that and would run interpreted.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > int(DEFAULT_CONF[key]):
        spark.conf.set(key, DEFAULT_CONF[key])


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_parcela_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="parcela-") as folder:     # read at once by addPyFile
        archive = Path(folder) / "parcela.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        shared = f"{ensure_checkpoint_dir(spark)}/{sc.applicationId}-parcela.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(shared)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).copyFromLocalFile(sc._jvm.org.apache.hadoop.fs.Path(str(archive)), path)
    sc.addPyFile(shared)
    sc._parcela_shipped = True


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept in memory, spilling to disk, for the iterative fits within the block only.

    Blocks that a lost executor held are computed again from the sources.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
