"""Exact order statistics by distributed selection.

A quantile needs the values at two ranks. Rows are collapsed to (group, value, count), values are dealt to value buckets at
approximate quantiles, the bucket totals (a bounded table per group) say which bucket holds a wanted rank, and only
those buckets are ordered, each in a window of its own. No buffer holds a group's values; a hot value is one row, a hot group is spread over its buckets."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augeval.functions.ranks import value_buckets


def quantiles(df: DataFrame, value_col: str, wanted: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Per group (null keys are groups) one column for each wanted quantile of the non-null values, linear between two ranks.

    A group without values gives no row; without ``by`` there is one row, with nulls for an empty table."""
    g = ["_g"] if by else []
    v = df.where(F.col(value_col).isNotNull()).select(*([F.struct(*by).alias("_g")] if by else []), F.col(value_col).cast("double").alias("_v"))
    vals = value_buckets(v.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c")), "_v", g)
    totals = vals.groupBy(*g, "_b").agg(F.sum("_c").alias("_t"))
    # A bounded number of buckets per group.
    every = Window.partitionBy(*(g or [F.col("_b") - F.col("_b")]))
    totals = totals.withColumn("_n", F.sum("_t").over(every)).withColumn(
        "_before", F.sum("_t").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * (F.col("_n") - 1)), F.ceil(q * (F.col("_n") - 1))) for q in wanted.values()])))
    inside = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_t")))
    held = totals.select(*g, "_b", "_n", "_before", inside.alias("_ranks")).where(F.size("_ranks") > 0)
    own = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = vals.join(held, [*g, "_b"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(own))
    found = found.withColumn("_rank", F.explode("_ranks")).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    at = found.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"), F.max("_n").alias("_n"))  # two ranks a quantile

    def linear(q: float):
        place = q * (F.col("_n") - 1)
        lo, hi = (F.try_element_at("_at", f(place)) for f in (F.floor, F.ceil))
        return lo + (hi - lo) * (place - F.floor(place))
    return at.select(*[F.col(f"_g.{c}").alias(c) for c in by], *[linear(q).alias(name) for name, q in wanted.items()])


def with_quantiles(grouped: DataFrame, df: DataFrame, value_col: str, wanted: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The columns of ``quantiles`` beside those of ``grouped`` (one row a group of ``by``; one row if there is none)."""
    q = quantiles(df, value_col, wanted, by)
    if not by:
        row = F.col("_q")
        one = grouped.withColumn("_q", q.select(F.struct(*wanted)).scalar())
        return one.select(*grouped.columns, *[row[c].alias(c) for c in wanted])
    q = q.select(F.struct(*by).alias("_key"), *wanted)
    return grouped.withColumn("_key", F.struct(*by)).join(q, "_key", "left").drop("_key")
