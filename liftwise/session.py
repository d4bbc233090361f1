"""Session settings and scratch location."""

from __future__ import annotations

import os
import tempfile
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the plans rely on. UTC because every window is a UTC day;
# the adaptive settings let Spark split a hot user's share of a shuffle even
# when that costs one more exchange after the join.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("liftwise")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LIFTWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder for written intermediates and stream checkpoints.

    The folder lies below ``spark.checkpoint.dir``, which a cluster points at
    shared storage. Only a local master may fall back to the machine's own
    temporary folder, since there driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{prefix}-{os.urandom(8).hex()}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"{prefix}-")


#: Drops a query's shuffle files when the query ends, where Spark has that setting.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, prefix: str = "liftwise") -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Cuts the lineage in a way that survives lost executors, so that several
    results can be derived from one attribution pass. Shuffle files of the
    write go when it ends, as nothing but the table is read after it.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark, prefix)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(f"{folder}/table")
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(f"{folder}/table")
    _FOLDERS[table] = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing will read again. Other frames are left alone."""
    for table in tables:
        folder = _FOLDERS.pop(table, None)
        if folder is not None:
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
