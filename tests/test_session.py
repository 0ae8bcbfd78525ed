"""Written tables: the shuffle files behind them do not wait for the driver's garbage collection."""
import os
import time

from pyspark.sql import functions as F

from augeval.session import CLEANUP, cut_lineage


def _shuffle_files(spark):
    root = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in root for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, conf = _shuffle_files(spark), spark.conf.get(CLEANUP)
    df = spark.range(20_000).groupBy((F.col("id") % 100).alias("k")).count()
    t = cut_lineage(df, "no-shuffle-files")
    for _ in range(50):  # files are removed behind the write
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and spark.conf.get(CLEANUP) == conf
    # The plan can be run and written again: its shuffles are made anew.
    assert t.count() == df.count() == cut_lineage(df, "again").count() == 100 and len(df.collect()) == len(df.collect()) == 100
