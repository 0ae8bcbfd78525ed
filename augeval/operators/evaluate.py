"""Prediction-table helpers: truth attachment, alignment, (re)standardization."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_truth(truth: DataFrame, pred: DataFrame, id_col: str, y_true: str = "y_true",
                 y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Truth left join predictions (null where no usable prediction) with the MAE over usable rows of each group."""
    by = list(by)
    j = truth.join(pred, [*by, id_col], "left")
    mae = j.groupBy(*by).agg(F.avg(F.abs(F.col(y_pred) - F.col(y_true))).alias("mae_usable"))
    j = j.join(mae, by) if by else j.withColumn("mae_usable", mae.scalar())
    return j.select(*by, id_col, y_true, y_pred, "mae_usable")


def alignment_check(a: DataFrame, b: DataFrame, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Entities in both tables and on one side only, per group (full outer join): a check for position-free alignment."""
    keys = [*by, id_col]
    j = a.select(*keys, F.lit(True).alias("_a")).join(b.select(*keys, F.lit(True).alias("_b")), keys, "full_outer")
    return j.groupBy(*by).agg(F.count_if(F.col("_a") & F.col("_b")).cast("bigint").alias("n_both"),
                              F.count_if(F.col("_b").isNull()).cast("bigint").alias("n_only_a"),
                              F.count_if(F.col("_a").isNull()).cast("bigint").alias("n_only_b"))


def standardize(df: DataFrame, by: Sequence[str], y: str, out: str = "z") -> DataFrame:
    """z-score by the group's own mean and sample SD (aggregate joined back on the group keys); a constant group, or one of
    a single row, has no scale and gets null."""
    st = df.groupBy(*by).agg(F.avg(y).alias("_m"), F.stddev_samp(y).alias("_s"))
    return df.join(st, list(by)).withColumn(out, F.try_divide(F.col(y) - F.col("_m"), F.col("_s")))


def unstandardize(df: DataFrame, z: str, out: str) -> DataFrame:
    """Inverse of ``standardize`` (needs its _m and _s columns)."""
    return df.withColumn(out, F.col(z) * F.col("_s") + F.col("_m"))


def scale_stats(df: DataFrame, by: Sequence[str], y: str, mean: str, sd: str) -> DataFrame:
    """Mean and sample SD of a column per group: one aggregate, one row a group."""
    return df.groupBy(*by).agg(F.avg(y).alias(mean), F.stddev_samp(y).alias(sd))


def restandardize(z, m1, s1, m2, s2) -> Column:
    """Map a score on scale (m1, s1) to scale (m2, s2) so that the underlying value is unchanged."""
    z = F.col(z) if isinstance(z, str) else z
    return F.try_divide(z * s1 + m1 - m2, s2)
