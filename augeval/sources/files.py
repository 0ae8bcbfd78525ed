"""File sources and sinks with declared schemas (no inference)."""
from __future__ import annotations

import codecs
import hashlib
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augeval.session import cut_lineage


def scan_columns(spark: SparkSession, path: str, schema: T.StructType, columns: dict[str, str]) -> DataFrame:
    """CSV scan with a declared schema, keeping only the named columns (the CSV source prunes the rest).
    ``columns`` maps source names (dots and parentheses allowed) to clean names, renamed at once."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in columns.items()])


TEST_METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mae", "rmse", "r2", "spearman")])
HISTORY = T.ArrayType(T.StructType([T.StructField("epoch", T.LongType()),
                                    T.StructField("train_mse_standardized", T.DoubleType()),
                                    T.StructField("val_mae", T.DoubleType())]))
RUN_RECORD = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("group", T.StringType()), T.StructField("seed", T.LongType()),
    T.StructField("model", T.StringType()), T.StructField("n_real", T.LongType()),
    T.StructField("n_train_rows", T.LongType()), T.StructField("best_epoch", T.LongType()),
    T.StructField("epochs_run", T.LongType()), T.StructField("best_val_mae", T.DoubleType()),
    T.StructField("test", TEST_METRICS), T.StructField("train_seconds", T.DoubleType()),
    T.StructField("history", HISTORY), T.StructField("settings_hash", T.StringType())])


def scan_runs(spark: SparkSession, path: str, forest_model: str = "random_forest") -> DataFrame:
    """Many one-object JSON files (optional fields absent in some shapes): nested test metrics flattened, forest
    runs prefixed 'rf_'."""
    r = spark.read.schema(RUN_RECORD).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    name = F.when(F.col("model") == forest_model, F.concat(F.lit("rf_"), F.col("run"))).otherwise(F.col("run"))
    return r.select(name.alias("run"), "group", "model", "seed", "n_real", "n_train_rows", "best_epoch", "epochs_run",
                    "best_val_mae", "test.*", "train_seconds")


def explode_history(runs: DataFrame, keys: Sequence[str] = ("run", "seed")) -> DataFrame:
    """One row per (run, seed, epoch) from the history array (``inline``)."""
    return runs.select(*keys, F.inline("history"))


def scan_predictions(spark: SparkSession, path: str, schema: T.StructType,
                     pattern: str = r"run=([^/]+)/seed=([0-9]+)/") -> DataFrame:
    """A folder of prediction files; run and seed are taken from each file's path."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    p = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(p, pattern, 1).alias("run"), F.regexp_extract(p, pattern, 2).cast("int").alias("seed"),
                     *schema.fieldNames())


def write_table(df: DataFrame, path: str, order: Sequence[str], fmt: str = "csv") -> None:
    """Write a (small, report-sized) result as one ordered file: range-partition to one partition, sort within it."""
    (df.repartitionByRange(1, *order).sortWithinPartitions(*order)
       .write.mode("overwrite").option("header", True).format(fmt).save(path))


STREAM_BYTES = 32 << 20   # larger files pass through a task in batches, smaller ones are read whole
PACKED = "*.{gz,bz2,deflate,lz4,snappy,zst,passthrough}"   # names that the text source would unpack


def manifest(spark: SparkSession, pattern: str, expected: Sequence[str]) -> DataFrame:
    """path, length and md5 of the matching files, against an expected name list (left join: missing files show).
    A file is one task's work, as an md5 is one chain over all bytes; a task holds a batch of a large file, never the whole of it.
    Large files with a name in PACKED are read whole (binaryFile's per-file limit applies)."""
    def whole(**options: str) -> DataFrame:
        return spark.read.format("binaryFile").options(**options).load(pattern)

    def summed(files: DataFrame) -> DataFrame:
        return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", F.md5("content").alias("md5"))

    files = summed(whole().where(F.col("length") <= STREAM_BYTES))
    longest = whole().agg(F.max("length")).first()[0] or 0
    if longest > STREAM_BYTES:
        packed = whole(pathGlobFilter=PACKED).where(F.col("length") > STREAM_BYTES)
        files = files.union(summed(packed)).union(_streamed(spark, pattern, longest))
    exp = spark.createDataFrame([(e,) for e in expected], "file string")
    return exp.join(files, "file", "left").withColumn("present", F.col("md5").isNotNull())


def _streamed(spark: SparkSession, pattern: str, longest: int) -> DataFrame:
    """file, length and md5 of the large files, a written table. A file comes as its lines (any bytes between two line feeds) in one
    split, as a split may be as long as the longest file; the largest files get a task of their own."""
    conf = {"spark.sql.files.maxPartitionBytes": str(longest), "spark.sql.files.minPartitionNum": "1",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(STREAM_BYTES)}
    before = {k: spark.conf.get(k, None) for k in conf}
    suffixes = PACKED[3:-1].replace(",", "|")
    meta = lambda name: F.col(f"_metadata.{name}")
    lines = spark.read.option("lineSep", "\n").text(pattern).where(
        (meta("file_size") > STREAM_BYTES) & ~meta("file_path").rlike(rf"\.({suffixes})$")).select(
        meta("file_name").alias("file"), meta("file_size").alias("length"), F.xxhash64(meta("file_path")).alias("id"),
        F.col("value").cast("binary").alias("line"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return cut_lineage(lines.mapInArrow(_line_digests(), "file string, length long, md5 string"), "manifest")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _line_digests() -> Callable:
    """Lines of whole files, one file after the other -> file, length, md5. The function goes to the workers by itself, without this module."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(name: str, length: int, n: int, plain, marked) -> pa.RecordBatch:
            # The lines do not tell whether the last one is ended, and the reader leaves out a byte order mark; the length tells both.
            for digest, left in ((plain, length - n), (marked, length - n - len(codecs.BOM_UTF8))):
                if left in (0, 1):
                    digest.update(b"\n" * left)
                    return pa.RecordBatch.from_pydict({"file": [unquote(name)], "length": [length], "md5": [digest.hexdigest()]})
            raise RuntimeError(f"{name}: {n} bytes read of {length}")

        at = None
        for b in batches:
            runs = pc.run_end_encode(b.column("id"))
            start = 0
            for end, key in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                lines = b.column("line").slice(start, end - start)
                if key != at:
                    if at is not None:
                        yield ended(*file, n, plain, marked)
                    at, file, n = key, (b.column("file")[start].as_py(), b.column("length")[start].as_py()), 0
                    plain, marked = hashlib.md5(), hashlib.md5(codecs.BOM_UTF8)
                else:
                    plain.update(b"\n")
                    marked.update(b"\n")
                    n += 1
                data = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), b"\n")[0].as_buffer()
                plain.update(data)
                marked.update(data)
                n, start = n + data.size, end
        if at is not None:
            yield ended(*file, n, plain, marked)
    return run
