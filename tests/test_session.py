import os
import time

from pyspark.sql import functions as F

from liftwise.session import SHUFFLE_CLEANUP, discard, materialize


def shuffle_bytes(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(d) for d in manager.localDirsString()]
    return sum(os.path.getsize(os.path.join(r, f)) for d in folders for r, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_"))


def test_shuffle_files_go_with_the_write(spark):
    before, setting = shuffle_bytes(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(8, "v")
    table = materialize(rows, "test-session")
    for _ in range(50):
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) <= before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert table.agg(F.sum("id")).first()[0] == sum(range(200_000))


def test_discard_deletes_only_written_tables(spark):
    table = materialize(spark.range(10), "test-session")
    files = [f.removeprefix("file://") for f in table.inputFiles()]
    discard(spark.range(3), table.where("id > 2"))
    assert files and all(os.path.exists(f) for f in files)
    discard(table, table)
    assert not any(os.path.exists(f) for f in files)
