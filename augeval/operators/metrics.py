"""Evaluation metrics over prediction tables (run, seed, entity, y_true, y_pred)."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augeval.functions.quantiles import with_quantiles
from augeval.functions.ranks import spearman


def regression_metrics(preds: DataFrame, by: Sequence[str] = ("run", "seed"), y_true: str = "y_true",
                       y_pred: str = "y_pred", with_spearman: bool = True) -> DataFrame:
    """n, MAE, RMSE, R2 (1 - SSE/SST, null when SST = 0), mean signed error and (optionally) Spearman per group."""
    e = F.col(y_pred) - F.col(y_true)
    sst = F.var_pop(y_true) * F.count(F.lit(1))
    base = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(sst > 0, 1 - F.try_divide(F.sum(e * e), sst)).alias("r2"), F.avg(e).alias("mean_signed_error"))
    return base.join(spearman(preds, y_true, y_pred, by), list(by), "left") if with_spearman else base


def run_summary(metrics: DataFrame, by: Sequence[str] = ("run",), cols: Sequence[str] = ("mae", "rmse", "r2"),
                seed_col: str = "seed") -> DataFrame:
    """Mean and SD over seeds of each metric, with the number of seeds."""
    aggs = [F.count_distinct(seed_col).alias("n_seeds")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return metrics.groupBy(*by).agg(*aggs)


def seed_completeness(df: DataFrame, run_col: str = "run", seed_col: str = "seed") -> DataFrame:
    """Runs lacking some seed of the global seed set."""
    total = df.select(F.count_distinct(seed_col)).scalar()
    per = df.groupBy(run_col).agg(F.count_distinct(seed_col).alias("n_seeds"))
    return per.filter(F.col("n_seeds") < total).withColumn("n_all_seeds", total)


def pivot_seeds(metrics: DataFrame, seeds: Sequence[int], value: str = "mae", run_col: str = "run",
                seed_col: str = "seed") -> DataFrame:
    """Run x seed matrix of a metric; columns ``seed_<s>``. The seed list is a parameter (no extra pass)."""
    p = metrics.groupBy(run_col).pivot(seed_col, list(seeds)).agg(F.first(value))
    return p.select(run_col, *[F.col(str(s)).alias(f"seed_{s}") for s in seeds])


def seed_mean_error(preds: DataFrame, by: Sequence[str] = ("run", "entity")) -> DataFrame:
    """Per-entity absolute error averaged over seeds."""
    return preds.groupBy(*by).agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("abs_error"),
                                  F.count(F.lit(1)).alias("n_seeds"))


def band(col, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Half-open bands [lo, hi) as a generated CASE (no join); out of range is null."""
    c = F.col(col) if isinstance(col, str) else col
    labels = labels or [f"[{lo:g}, {hi:g})" for lo, hi in zip(edges[:-1], edges[1:])]
    expr = None
    for (lo, hi), lab in zip(zip(edges[:-1], edges[1:]), labels):
        cond = (c >= F.lit(lo)) & (c < F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def band_table(spark, edges: Sequence[float], labels: Sequence[str] | None = None) -> DataFrame:
    """The band table (size fixed by the parameter list)."""
    labels = labels or [f"[{lo:g}, {hi:g})" for lo, hi in zip(edges[:-1], edges[1:])]
    rows = [(i, lab, float(lo), float(hi)) for i, (lab, lo, hi) in enumerate(zip(labels, edges[:-1], edges[1:]))]
    return spark.createDataFrame(rows, "band_order int, band string, lo double, hi double")


def band_join(df: DataFrame, col: str, edges: Sequence[float], out: str = "band") -> DataFrame:
    """Assign bands with a range condition against the broadcast band table (bounded by the parameter list)."""
    bt = band_table(df.sparkSession, edges).withColumnRenamed("band", out)
    j = df.join(F.broadcast(bt), (F.col(col) >= F.col("lo")) & (F.col(col) < F.col("hi")), "left")
    return j.drop("lo", "hi", "band_order")


def error_by_band(preds: DataFrame, edges: Sequence[float]) -> DataFrame:
    """n, MAE and mean signed error per observed band of y_true (rows outside every band leave the group-by)."""
    e = F.col("y_pred") - F.col("y_true")
    b = preds.withColumn("band", band("y_true", edges)).filter(F.col("band").isNotNull())
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
                                 F.avg(e).alias("mean_signed_error"))


def stratified_error(preds: DataFrame, stratum: Column, models: Sequence[str], model_col: str = "run") -> DataFrame:
    """Per stratum: n and MAE per model, plus an 'all' row (rollup + grouping)."""
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    d = preds.withColumn("stratum", stratum).filter(F.col("stratum").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")] + [
        F.avg(F.when(F.col(model_col) == m, e)).alias(f"mae_{m}") for m in models]
    r = d.rollup("stratum").agg(*aggs, F.grouping("stratum").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("stratum")).alias("stratum"),
                    "n", *[f"mae_{m}" for m in models])


def error_by_strata(errors: DataFrame, strata: DataFrame, models: Sequence[str], id_col: str = "entity", model_col: str = "run",
                    error_col: str = "abs_error") -> DataFrame:
    """Model error by several kinds of strata at once: kind, stratum, n (entities), MAE per model, and an 'all' row per kind.

    ``errors``: model, id, error (one row each). ``strata``: id, kind, stratum (one row an entity and kind; a null stratum counts in
    'all' only). Errors are spread to a column a model before the join, so an entity meets its strata once."""
    wide = errors.groupBy(id_col).agg(*[F.avg(F.when(F.col(model_col) == m, F.col(error_col))).alias(f"_e_{m}") for m in models])
    r = strata.join(wide, id_col).rollup("kind", "stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"_e_{m}").alias(f"mae_{m}") for m in models],
        F.grouping("kind").alias("_no_kind"), F.grouping("stratum").alias("_all"))
    r = r.where((F.col("_no_kind") == 0) & ((F.col("_all") == 1) | F.col("stratum").isNotNull()))
    return r.select("kind", F.when(F.col("_all") == 1, "all").otherwise(F.col("stratum")).alias("stratum"), "n", *[f"mae_{m}" for m in models])


def dense_histogram(df: DataFrame, col: str, edges: Sequence[float], by_total: bool = True) -> DataFrame:
    """Counts and shares per band including empty bands (band table left join counts)."""
    bt = band_table(df.sparkSession, edges)
    counts = df.withColumn("band", band(col, edges)).filter(F.col("band").isNotNull()).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    j = bt.join(counts, "band", "left").select("band_order", "band", F.coalesce("n", F.lit(0)).alias("n"))
    return j.withColumn("share", F.try_divide(F.col("n"), total))


def quantile_summary(df: DataFrame, col: str, qs: Sequence[float], above: float, below: float,
                     identical: float = 0.9999) -> DataFrame:
    """Exact quantiles (linear interpolation), shares above / below thresholds, count of (near) identical."""
    aggs = [F.avg(F.when(F.col(col) > above, 1.0).otherwise(0.0)).alias("share_above"),
            F.avg(F.when(F.col(col) < below, 1.0).otherwise(0.0)).alias("share_below"),
            F.count_if(F.col(col) >= identical).cast("bigint").alias("n_identical")]
    return with_quantiles(df.agg(*aggs), df, col, {f"q{int(round(x * 100)):02d}": x for x in qs})


def density_histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Density per fixed-width bin over [lo, hi]; the last bin is closed on the right; outside is dropped."""
    width = (hi - lo) / bins
    d = df.filter(F.col(col).between(lo, hi))
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    n = d.select(F.count(F.lit(1))).scalar()
    return d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"), "n",
        F.try_divide(F.col("n"), n * F.lit(width)).alias("density"))


def median_error_by_band(preds: DataFrame, width: float, min_rows: int = 10) -> DataFrame:
    """Median signed error (prediction minus truth) per fixed band of y_true with at least ``min_rows`` rows."""
    e = F.col("y_pred") - F.col("y_true")
    d = preds.select((F.floor(F.col("y_true") / width) * width).alias("band_lo"), e.alias("_error"))
    g = d.groupBy("band_lo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    return with_quantiles(g, d, "_error", {"median_error": 0.5}, ["band_lo"])


def prediction_noise(preds: DataFrame, run_col: str = "run", pass_col: str = "seed",
                     entity_col: str = "entity") -> DataFrame:
    """Over repeated passes: per-pass MAE then mean / SD / min / max; per-entity prediction SD then mean / max."""
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    per_pass = preds.groupBy(run_col, pass_col).agg(F.avg(e).alias("_mae")).groupBy(run_col).agg(
        F.avg("_mae").alias("mae_mean"), F.stddev_samp("_mae").alias("mae_sd"),
        F.min("_mae").alias("mae_min"), F.max("_mae").alias("mae_max"))
    per_ent = preds.groupBy(run_col, entity_col).agg(F.stddev_samp("y_pred").alias("_sd")).groupBy(run_col).agg(
        F.avg("_sd").alias("entity_sd_mean"), F.max("_sd").alias("entity_sd_max"))
    return per_pass.join(per_ent, run_col)


def noise_floor(measured: DataFrame, errors: DataFrame, models: Sequence[str], id_col: str = "entity",
                model_col: str = "run") -> DataFrame:
    """Entities with 2+ measurements: count, median / mean SD, 2/sqrt(pi) x SD; model MAE inside and outside.

    ``measured``: id, value rows (several per entity). ``errors``: model, id, abs_error. Long (quantity, value)."""
    per = measured.groupBy(id_col).agg(F.count(F.lit(1)).alias("_c"), F.stddev_samp("value").alias("_sd"))
    per = per.withColumn("_multi", F.col("_c") >= 2)
    k = 2 / math.sqrt(math.pi)
    floor = per.agg(F.count_if("_multi").cast("double").alias("n_multi"),
                    F.avg(F.when(F.col("_multi"), F.col("_sd"))).alias("mean_sd"))
    floor = with_quantiles(floor, per.where("_multi"), "_sd", {"median_sd": 0.5})
    floor = floor.withColumn("expected_diff_median", F.col("median_sd") * k).withColumn(
        "expected_diff_mean", F.col("mean_sd") * k)
    ej = errors.join(per.select(id_col, "_multi"), id_col)
    aggs = []
    for m in models:
        aggs += [F.avg(F.when((F.col(model_col) == m) & F.col("_multi"), F.col("abs_error"))).alias(f"mae_inside_{m}"),
                 F.avg(F.when((F.col(model_col) == m) & ~F.col("_multi"), F.col("abs_error"))).alias(f"mae_outside_{m}")]
    model_part = ej.agg(*aggs)
    cols = ["n_multi", "median_sd", "mean_sd", "expected_diff_median", "expected_diff_mean"]
    mcols = [c for m in models for c in (f"mae_inside_{m}", f"mae_outside_{m}")]
    a = floor.selectExpr(f"stack({len(cols)}, " + ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols) + ") AS (quantity, value)")
    b = model_part.selectExpr(f"stack({len(mcols)}, " + ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in mcols) + ") AS (quantity, value)")
    return a.unionByName(b)
