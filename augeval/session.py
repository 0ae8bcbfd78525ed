"""Session helpers: one place for the settings every job here relies on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# A query's shuffle files go when it has ended, not at the driver's next garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings the operators assume. Timestamps are compared with a UTC oracle; AQE re-plans joins by the
# sizes it measures at run time (the size check behind every broadcast that is not bounded by a parameter).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "augeval", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above; ``extra`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, a laptop) gets a fresh temporary folder;
    a cluster session must name a shared folder and is never given a machine-local one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    path = tempfile.mkdtemp(prefix="augeval-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage with a written table: parquet in a fresh folder under the shared checkpoint folder, read back.

    Survives lost executors (readers recompute nothing upstream) and, unlike an RDD checkpoint, later plans get a
    columnar scan with column pruning and pushed filters. The shuffle files behind the table, which nobody reads again, go at once:
    a plan of many such steps holds one step's files on the executors' disks, not all of them."""
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.parquet(path)
    out._written_at = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables that ``cut_lineage`` returned, once everything derived from them is written itself."""
    for t in tables:
        _remove(t.sparkSession, t._written_at)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(table_path(sf_dir, name))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for tables a plan writes and reads back.

    All folders of an application lie under one, which ``drop_scratch`` removes."""
    import uuid
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/augeval-scratch/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> bool:
    """Remove the tables that this application's plans have written. Call it when their results are no longer read."""
    return _remove(spark, _scratch_root(spark))


def _remove(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin a small-in-bytes but CPU-heavy input over the cores when its scan yields fewer partitions
    than the cluster has cores (e.g. one small parquet file of long texts). A large input is already split by
    the scan and is returned unchanged (no extra shuffle)."""
    target = factor * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target // factor else df
