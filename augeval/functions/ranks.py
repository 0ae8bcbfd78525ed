"""Tie-averaged ranks and rank correlation without a single-partition window.

A rank needs the count of smaller values in the group. Rows are first collapsed to (group, value, count);
a hot group is then cut into value buckets at approximate quantiles (a bounded sketch per group), the bucket
totals (a small table) give each bucket's offset, and only a bucket's own values are ordered in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augeval.session import cut_lineage


def value_buckets(vals: DataFrame, value_col: str, by: Sequence[str] = (), fanout: int = 32, accuracy: int = 10000) -> DataFrame:
    """Add ``_b``, the bucket of a value in its group, in value order: fanout * fanout buckets at approximate quantiles of the rows
    of ``vals`` (a bounded sketch per group), found by a two-level search of about 2 * fanout comparisons."""
    buckets = fanout * fanout
    pcts = [i / buckets for i in range(1, buckets)]
    sketch = F.percentile_approx(value_col, pcts, accuracy)   # bounded sketch per group, not the group's rows
    v = F.col(value_col)
    if by:
        cut_join = vals.join(vals.groupBy(*by).agg(sketch.alias("_cuts")), list(by))
    else:   # one group: the cut points are a scalar subquery
        cut_join = vals.withColumn("_cuts", vals.select(sketch).scalar())
    # coarse bucket: how many of every fanout-th cut lie below v; fine: the same inside that coarse range
    coarse_cuts = F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda i: F.element_at("_cuts", i * fanout))
    cut_join = cut_join.withColumn("_hi", F.size(F.filter(coarse_cuts, lambda c: c < v)))
    fine_cuts = F.slice("_cuts", F.col("_hi") * fanout + 1, F.lit(fanout - 1))
    return cut_join.withColumn("_b", F.col("_hi") * fanout + F.size(F.filter(fine_cuts, lambda c: c < v))).drop("_cuts", "_hi")


def rank_values(vals: DataFrame, value_col: str, by: Sequence[str] = (), out: str = "rank",
                fanout: int = 32, accuracy: int = 10000) -> DataFrame:
    """Add the tie-averaged rank (1-based) of each distinct value of a group, ``_c`` rows having it."""
    by = list(by)
    vb = value_buckets(vals, value_col, by, fanout, accuracy)
    # read twice below (bucket totals, local ranks): cut its lineage once so the bucket search runs once
    vb = cut_lineage(vb, "rank-buckets")
    tot = vb.groupBy(*by, "_b").agg(F.sum("_c").alias("_bt"))
    wo = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wo), F.lit(0))).drop("_bt")
    wl = Window.partitionBy(*by, "_b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    local = vb.withColumn("_before", F.coalesce(F.sum("_c").over(wl), F.lit(0)))
    return local.join(offs, [*by, "_b"]).select(*vals.columns, (F.col("_off") + F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out))


def average_rank(df: DataFrame, value_col: str, by: Sequence[str] = (), out: str = "rank",
                 fanout: int = 32, accuracy: int = 10000) -> DataFrame:
    """Add the tie-averaged rank (1-based) of ``value_col`` within ``by``; null values get a null rank."""
    by = list(by)
    vals = df.filter(F.col(value_col).isNotNull()).groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(rank_values(vals, value_col, by, out, fanout, accuracy).drop("_c"), [*by, value_col], "left")


def guarded_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation, null (not an error) when either side is constant or has < 2 rows."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    ok = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), out: str = "spearman") -> DataFrame:
    """Spearman's rho per group: Pearson correlation of tie-averaged ranks."""
    r = average_rank(average_rank(df, x, by, "_rx"), y, by, "_ry")
    return r.groupBy(*by).agg(guarded_corr("_rx", "_ry").alias(out))
