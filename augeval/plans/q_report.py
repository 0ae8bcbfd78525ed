"""Registered plans: sources / sinks and report numbers."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from augeval.functions.text import mean_sd_text, p_text, signed_fixed
from augeval.plans import roles, stages
from augeval.plans.oracle_roles import with_roles
from augeval.plans.q_eval import BASIC_SQL, _DIFF_EXTRA, _basic, _diff, _hist_mapped, _HIST_MAP_SQL
from augeval.plans.registry import query
from augeval.session import load, scratch_path
from augeval.sources import files

OBS_CSV_SCHEMA = T.StructType([
    T.StructField("order_key", T.LongType()), T.StructField("line_no", T.IntegerType()),
    T.StructField("part_key", T.LongType()), T.StructField("meta.raw_key", T.StringType()),
    T.StructField("labels.value(text)", T.StringType()), T.StructField("n_points", T.IntegerType()),
    T.StructField("reliability", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("class", T.StringType())])


@query("scan_columns", with_roles("SELECT raw_key, value_text, reliability FROM obs", "obs"))
def q_scan_columns(spark, sf):
    """Obs written as CSV with awkward header names, scanned back with a schema, three columns kept."""
    path = scratch_path(spark, "obs-csv")
    o = roles.obs(spark, sf).withColumnRenamed("raw_key", "meta.raw_key").withColumnRenamed("value_text", "labels.value(text)")
    o.write.option("header", True).csv(path)
    return files.scan_columns(spark, path, OBS_CSV_SCHEMA, {"meta.raw_key": "raw_key", "labels.value(text)": "value_text",
                                                             "reliability": "reliability"})


def _records(spark, sf):
    m = _basic(spark, sf)
    forest = F.col("run") == "R"
    return m.select(
        F.concat(F.lit("run_"), F.col("run")).alias("run"),
        F.when(F.col("run") == "A", "baseline").otherwise("synthetic").alias("group"),
        F.col("seed").cast("bigint").alias("seed"),
        F.when(forest, "random_forest").otherwise("transformer").alias("model"),
        F.col("n").alias("n_real"), F.col("n").alias("n_train_rows"),
        F.when(~forest, F.col("seed").cast("bigint")).alias("best_epoch"),
        F.when(~forest, F.col("seed").cast("bigint") + 3).alias("epochs_run"),
        F.when(~forest, F.col("mae") * 1.1).alias("best_val_mae"),
        F.struct("mae", "rmse", "r2", F.lit(None).cast("double").alias("spearman")).alias("test"),
        (F.col("n") * 0.5).alias("train_seconds"))


_RUNS_SQL = f"""SELECT CASE WHEN run = 'R' THEN 'rf_run_R' ELSE 'run_' || run END AS run,
    CASE WHEN run = 'A' THEN 'baseline' ELSE 'synthetic' END AS "group",
    CASE WHEN run = 'R' THEN 'random_forest' ELSE 'transformer' END AS model, CAST(seed AS BIGINT) AS seed,
    n AS n_real, n AS n_train_rows, CASE WHEN run <> 'R' THEN CAST(seed AS BIGINT) END AS best_epoch,
    CASE WHEN run <> 'R' THEN CAST(seed AS BIGINT) + 3 END AS epochs_run, CASE WHEN run <> 'R' THEN mae * 1.1 END AS best_val_mae,
    mae, rmse, r2, CAST(NULL AS DOUBLE) AS spearman, CAST(n * 0.5 AS DOUBLE) AS train_seconds FROM m"""


@query("scan_run_records", with_roles(_RUNS_SQL, "preds", extra=[("m", BASIC_SQL)]))
def q_scan_run_records(spark, sf):
    """S3: one JSON object file per run record (forest records lack the epoch fields), scanned and flattened."""
    path = scratch_path(spark, "runs")
    rec = _records(spark, sf)
    # one object per file: each (run, seed) record is its own partition directory
    rec.withColumn("_run", F.col("run")).withColumn("_seed", F.col("seed")).repartition("_run", "_seed") \
        .write.partitionBy("_run", "_seed").json(path)
    return files.scan_runs(spark, path)


@query("explode_history", with_roles("SELECT run, CAST(epoch AS BIGINT) AS epoch, val_mae / 10.0 AS train_mse_standardized, val_mae FROM hist", "hist"))
def q_explode_history(spark, sf):
    """Per-run records carrying the epoch history as an array of structs, written, read, then ``inline``d."""
    h = roles.hist(spark, sf)
    rec = h.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(
        F.col("epoch").cast("bigint").alias("epoch"), (F.col("val_mae") / 10.0).alias("train_mse_standardized"),
        F.col("val_mae")))).alias("history"))
    path = scratch_path(spark, "hist")
    rec.write.json(path)
    back = spark.read.schema(T.StructType([T.StructField("run", T.LongType()),
                                           T.StructField("history", files.HISTORY)])).json(path)
    return files.explode_history(back, ["run"])


PRED_SCHEMA = T.StructType([T.StructField("entity", T.LongType()), T.StructField("y_true", T.DoubleType()),
                            T.StructField("y_pred", T.DoubleType())])


@query("scan_predictions", digits=8, tie_safe=True, sql=with_roles("SELECT run, seed, entity, y_true, y_pred FROM preds", "preds"))
def q_scan_predictions(spark, sf):
    """One prediction folder per (run, seed); run and seed are read back from the file path."""
    path = scratch_path(spark, "preds")
    roles.preds(spark, sf).write.partitionBy("run", "seed").option("header", True).csv(path)
    return files.scan_predictions(spark, path, PRED_SCHEMA)


@query("write_table", with_roles("""
  SELECT run, count(DISTINCT seed) AS n_seeds, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_sd FROM m GROUP BY run
""", "preds", extra=[("m", BASIC_SQL)]))
def q_write_table(spark, sf):
    """A result table written as one ordered CSV file and read back."""
    from augeval.operators import metrics
    t = metrics.run_summary(_basic(spark, sf), cols=["mae"])
    path = scratch_path(spark, "table")
    files.write_table(t, path, ["run"])
    schema = "run string, n_seeds bigint, mae_mean double, mae_sd double"
    return spark.read.schema(schema).option("header", True).csv(path)


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("file_manifest")
def q_file_manifest(spark, sf):
    """Length and md5 of every input table file against the expected list."""
    m = files.manifest(spark, f"{sf}/*.parquet", [f"{t}.parquet" for t in _TABLES])
    return m.select("file", "length", "md5", "present")


@query("run_matrix", with_roles("""
  SELECT g.run_arm, coalesce(bool_or(c.n_real = 250 AND c.complete), false) AS n250,
         coalesce(bool_or(c.n_real = 500 AND c.complete), false) AS n500
  FROM (SELECT * FROM (VALUES ('real'), ('generated'), ('labeled')) a(run_arm)) g
  LEFT JOIN (SELECT run_arm, n_real, count(DISTINCT run_seed) = (SELECT count(DISTINCT run_seed) FROM hm) AS complete
             FROM hm GROUP BY run_arm, n_real) c ON c.run_arm = g.run_arm
  GROUP BY g.run_arm
""", "hist", extra=[("hm", _HIST_MAP_SQL)]))
def q_run_matrix(spark, sf):
    """Configuration x size presence (every seed present), over the full configuration grid."""
    h = _hist_mapped(spark, sf)
    total = h.select(F.count_distinct("run_seed")).scalar()
    c = h.groupBy("run_arm", "n_real").agg((F.count_distinct("run_seed") == total).alias("complete"))
    grid = spark.createDataFrame([("real",), ("generated",), ("labeled",)], "run_arm string")
    j = grid.join(c, "run_arm", "left")
    return j.groupBy("run_arm").agg(
        F.coalesce(F.bool_or((F.col("n_real") == 250) & F.col("complete")), F.lit(False)).alias("n250"),
        F.coalesce(F.bool_or((F.col("n_real") == 500) & F.col("complete")), F.lit(False)).alias("n500"))


@query("fact_table", with_roles("""
  SELECT 'n_obs' AS key, CAST(count(*) AS DOUBLE) AS value FROM obs
  UNION ALL SELECT 'n_valid', CAST(count(*) AS DOUBLE) FROM obs_valid
  UNION ALL SELECT 'n_entities', CAST(count(DISTINCT entity_id) AS DOUBLE) FROM obs_valid
  UNION ALL SELECT 'n_requests', CAST(count(*) AS DOUBLE) FROM log
  UNION ALL SELECT 'total_cost_usd', sum(cost_usd) FROM log
  UNION ALL SELECT 'mean_value', avg(value) FROM obs_valid
""", "obs_valid", "log"))
def q_fact_table(spark, sf):
    """One-row aggregates of several tables as a long (key, value) table (``stack``)."""
    o = roles.obs(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("n_obs"))
    v = stages.obs_valid(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("n_valid"),
                                        F.count_distinct("entity_id").cast("double").alias("n_entities"),
                                        F.avg("value").alias("mean_value"))
    lg = roles.log(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("n_requests"),
                                  F.sum("cost_usd").alias("total_cost_usd"))
    parts = []
    for df in (o, v, lg):
        cols = df.columns
        parts.append(df.selectExpr(f"stack({len(cols)}, " + ", ".join(f"'{c}', {c}" for c in cols) + ") AS (key, value)"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("multiple_flags", """
  SELECT lang, avg(CASE WHEN n_chars % 5 = 0 THEN 1.0 ELSE 0.0 END) AS share_mult5,
         avg(CASE WHEN n_chars % 10 = 0 THEN 1.0 ELSE 0.0 END) AS share_mult10 FROM documents GROUP BY lang
""")
def q_multiple_flags(spark, sf):
    """share of labels that are multiples of 5 and of 10 (n_chars as the label)."""
    d = load(spark, sf, "documents")
    return d.groupBy("lang").agg(F.avg(F.when(F.col("n_chars") % 5 == 0, 1.0).otherwise(0.0)).alias("share_mult5"),
                                 F.avg(F.when(F.col("n_chars") % 10 == 0, 1.0).otherwise(0.0)).alias("share_mult10"))


@query("text_length_stats", """
  SELECT lang, avg(length(text)) AS mean_length, count_if(contains(text, '*'))::BIGINT AS n_with_marker
  FROM documents GROUP BY lang
""")
def q_text_length_stats(spark, sf):
    """mean text length and texts containing a marker, per language (whole texts)."""
    d = load(spark, sf, "documents")
    return d.groupBy("lang").agg(F.avg(F.char_length("text")).alias("mean_length"),
                                 F.count_if(F.col("text").contains("*")).cast("bigint").alias("n_with_marker"))


@query("format_delta", with_roles("""
  SELECT label,
    CASE WHEN round_even(mean, 2) > 0 THEN '+' || printf('%.2f', abs(round_even(mean, 2)))
         WHEN round_even(mean, 2) < 0 THEN '-' || printf('%.2f', abs(round_even(mean, 2)))
         ELSE printf('%.2f', abs(round_even(mean, 2))) END AS delta_text,
    printf('%.2f ± %.2f', round_even(mean, 2), round_even(sd, 2)) AS mean_sd_text
  FROM g
""", "preds", extra=_DIFF_EXTRA))
def q_format_delta(spark, sf):
    """signed fixed-point differences (no sign on zero) and 'm ± s' texts of the seed-matched comparisons."""
    d = _diff(spark, sf)
    return d.select("label", signed_fixed("mean").alias("delta_text"), mean_sd_text("mean", "sd").alias("mean_sd_text"))
