"""Seed-matched comparisons, paired tests and early-stopping replay over per-epoch histories."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augeval.functions.ranks import rank_values
from augeval.functions.stats import signed_rank_is_exact, signed_rank_p, t_two_sided_p


def seed_pairs(metrics: DataFrame, pairs: DataFrame, run_col: str = "run", seed_col: str = "seed",
               value: str = "mae") -> DataFrame:
    """Pair table (label, run_a, run_b) joined to the long metric table twice on (run, seed); seeds missing on
    either side drop out (inner joins). Output: label, seed, a, b, diff = a - b."""
    a = metrics.select(F.col(run_col).alias("run_a"), seed_col, F.col(value).alias("a"))
    b = metrics.select(F.col(run_col).alias("run_b"), seed_col, F.col(value).alias("b"))
    return (pairs.join(a, "run_a").join(b, ["run_b", seed_col])
                 .select("label", seed_col, "a", "b", (F.col("a") - F.col("b")).alias("diff")))


def signed_rank(paired: DataFrame, by: Sequence[str] = ("label",), diff: str = "diff") -> DataFrame:
    """Wilcoxon's signed-rank test per group, for any number of pairs: n, zeros, w_plus, w_minus, wilcoxon_p, wilcoxon_method.

    Differences are collapsed to (group, absolute value) with their counts by sign, the values are ranked in buckets, and the
    rank sums and tie groups are partial aggregates, so a group of any size is spread over many tasks. Null differences are left out."""
    by, d = list(by), F.col(diff)
    rows = paired.where(d.isNotNull())
    vals = rows.where(d != 0).groupBy(*by, F.abs(d).alias("_a")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(d > 0).alias("_plus"))
    r = rank_values(vals, "_a", by, "_rank").groupBy(*by).agg(
        F.sum(F.col("_rank") * F.col("_plus")).alias("w_plus"), F.sum(F.col("_rank") * (F.col("_c") - F.col("_plus"))).alias("w_minus"),
        F.sum(F.pow(F.col("_c").cast("double"), F.lit(3)) - F.col("_c")).alias("_ties"))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("zeros")).join(r, by, "left").fillna(0.0, ["w_plus", "w_minus", "_ties"])
    method = F.when(F.col("n") == F.col("zeros"), "all zero").when(signed_rank_is_exact("n", "zeros", "_ties"), "exact").otherwise("normal")
    return g.select(*by, "n", "zeros", "w_plus", "w_minus", signed_rank_p("w_plus", "w_minus", "n", "zeros", "_ties").alias("wilcoxon_p"),
                    method.alias("wilcoxon_method"))


def seed_matched_diff(paired: DataFrame, by: Sequence[str] = ("label",), diff: str = "diff", min_pairs: int = 2) -> DataFrame:
    """Per pair: n, mean, SD, min, max, same-sign count and paired-t p (n >= min_pairs)."""
    by, d = list(by), F.col(diff)
    sums = [F.count_if(F.signum(d) == s).cast("bigint").alias(f"_sign{s + 1}") for s in (-1, 0, 1)]
    g = paired.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"),
                                F.min(d).alias("min"), F.max(d).alias("max"), *sums).filter(F.col("n") >= min_pairs)
    same = F.when(F.col("mean") > 0, F.col("_sign2")).when(F.col("mean") < 0, F.col("_sign0")).otherwise(F.col("_sign1"))
    t = F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return g.select(*by, "n", "mean", "sd", "min", "max", same.alias("same_sign"),
                    F.concat(same.cast("string"), F.lit("/"), F.col("n").cast("string")).alias("same_sign_label"),
                    F.when(F.col("sd") > 0, t_two_sided_p(t, F.col("n") - 1)).alias("t_p"))


def early_stop(hist: DataFrame, keys: Sequence[str], order: str, metric: str, patience, carry: Sequence[str] = ()) -> DataFrame:
    """Replay of early stopping with STRICT improvement: per run, the best row when training stops after
    ``patience`` non-improving steps (or at the last step). Windows are per run (a bounded history).

    ``patience`` is a number or the name of a column (one replay per patience value in a single pass).
    Steps are counted by rows, so gaps in ``order`` do not count as waiting. ``carry`` names further columns to report at
    the best step (such as a test metric). Output: keys, best_<order>, best_<metric>, best_<carry>, steps_run."""
    keys = list(keys)
    patience = F.col(patience) if isinstance(patience, str) else F.lit(patience)
    w = Window.partitionBy(*keys).orderBy(order)
    prior_min = F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = hist.withColumn("_improved", prior_min.isNull() | (F.col(metric) < prior_min))
    h = h.withColumn("_step", F.row_number().over(w))
    h = h.withColumn("_last_imp", F.max(F.when(F.col("_improved"), F.col("_step"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("_gap", F.col("_step") - F.col("_last_imp"))
    stop = h.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_gap") >= patience, F.col(order))),
                                           F.max(order)).alias("steps_run"))
    best = (h.join(stop, keys).filter(F.col("_improved") & (F.col(order) <= F.col("steps_run")))
              .groupBy(*keys, "steps_run")
              .agg(F.max_by(F.struct(order, metric, *carry), F.col(order)).alias("_b")))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(f"best_{c}") for c in (order, metric, *carry)], "steps_run")


def best_step(hist: DataFrame, keys: Sequence[str], order: str, metric: str, carry: Sequence[str] = ()) -> DataFrame:
    """First row with the smallest metric per run (partial aggregation, no window)."""
    b = hist.groupBy(*keys).agg(F.min_by(F.struct(order, metric, *carry), F.struct(F.col(metric), F.col(order))).alias("_b"))
    return b.select(*keys, *[F.col(f"_b.{c}").alias(f"best_{c}") for c in (order, metric, *carry)])
