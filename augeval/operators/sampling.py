"""Seeded, exact, reproducible splits and samples without a single-partition window.

Exact global numbering in a seeded order: the order key is md5('seed|id'); rows are grouped into prefix
buckets of that hash (uniform by construction, so no hot bucket), a small table of bucket counts gives each
bucket's offset, and rows are numbered inside their own bucket only.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augeval.functions.keys import seeded_hash


def number_by(df: DataFrame, order_col: str, tie_cols: Sequence[str] = (), out: str = "rn",
              prefix_chars: int = 4) -> DataFrame:
    """Exact 1-based row number in (order_col, *tie_cols) order; ``order_col`` is a uniform hex hash text.

    The offset table has 16^prefix_chars rows at most; each window holds one bucket."""
    b = F.substring(F.col(order_col), 1, prefix_chars)
    d = df.withColumn("_bk", b)
    counts = d.groupBy("_bk").agg(F.count(F.lit(1)).alias("_bc"))
    wo = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)   # over the small bucket table only
    offs = counts.withColumn("_off", F.coalesce(F.sum("_bc").over(wo), F.lit(0))).drop("_bc")
    wl = Window.partitionBy("_bk").orderBy(order_col, *tie_cols)
    local = d.withColumn("_rl", F.row_number().over(wl))
    return local.join(offs, "_bk").withColumn(out, F.col("_off") + F.col("_rl")).drop("_bk", "_off", "_rl")


def seeded_order(df: DataFrame, id_col: str, seed: int, out: str = "rn") -> DataFrame:
    """Exact position of every row in the order of md5('seed|id')."""
    d = df.withColumn("_h", seeded_hash(seed, id_col))
    return number_by(d, "_h", [id_col], out=out).drop("_h")


def seeded_split(df: DataFrame, id_col: str, seed: int, test_fraction: float = 0.2,
                 val_fraction: float = 0.1) -> DataFrame:
    """Exact sizes: round(n x test_fraction) test, round(rest x val_fraction) validation, the rest train
    (half-even rounding), in the seeded md5 order."""
    n = df.select(F.count(F.lit(1))).scalar()
    n_test = F.bround(n * F.lit(test_fraction), 0)
    n_val = F.bround((n - n_test) * F.lit(val_fraction), 0)
    o = seeded_order(df, id_col, seed, "_pos")
    split = F.when(F.col("_pos") <= n_test, "test").when(F.col("_pos") <= n_test + n_val, "validation").otherwise("train")
    return o.withColumn("split", split).drop("_pos")


def split_by_threshold(df: DataFrame, id_col: str, seed: int, test_fraction: float = 0.2,
                       val_fraction: float = 0.1) -> DataFrame:
    """Stateless split by hash threshold (no count, no numbering): sizes are expected, not exact."""
    u = F.conv(F.substring(seeded_hash(seed, id_col), 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))
    t = test_fraction
    v = t + (1 - t) * val_fraction
    return df.withColumn("split", F.when(u < t, "test").when(u < v, "validation").otherwise("train"))


def nested_subsets(df: DataFrame, id_col: str, seed: int, sizes: Sequence[int]) -> DataFrame:
    """First n of one seeded order for every n in ``sizes``, plus 'full': long (subset, id, position)."""
    o = seeded_order(df, id_col, seed, "position")
    labels = F.array(*[F.when(F.col("position") <= n, F.lit(f"n{n}")) for n in sizes], F.lit("full"))
    return o.select(F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("subset"), id_col, "position")


def distinct_sample(df: DataFrame, cols: Sequence[str], n: int, seed: int) -> DataFrame:
    """Distinct rows, then exactly n of them (all when fewer) in seeded hash order. The limit is the feature:
    a top-n in hash order (TakeOrderedAndProject), not a cap to save work."""
    d = df.select(*cols).dropDuplicates()
    h = seeded_hash(seed, *cols)
    return d.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


def pilot_head(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """First k rows in id order (top-k)."""
    return df.orderBy(id_col).limit(k)


def shuffle_labels(df: DataFrame, id_col: str, value_col: str, seed: int, base_seed: int = 0) -> DataFrame:
    """Permute values across rows, entities kept, fixed per seed: the row at position i of the base order
    (md5('base_seed|id')) receives the value of the row at position i of the seeded order (md5('seed|id')).
    Two exact numberings joined on the position; ids must be unique."""
    by_base = seeded_order(df.select(id_col), id_col, base_seed, "_p")
    by_seed = seeded_order(df.select(id_col, value_col), id_col, seed, "_p").select(
        "_p", F.col(value_col).alias("shuffled"))
    return by_base.join(by_seed, "_p").join(df, id_col).drop("_p")


def number_within(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: F.Column, out: str = "rn") -> DataFrame:
    """Exact 1-based row number per group in ``order`` without holding a whole group in one window: ``bucket`` is a
    coarse, order-preserving key (e.g. the day of a timestamp); the per-(group, bucket) counts (a small table) give
    offsets, and each window holds one (group, bucket)."""
    by = list(by)
    d = df.withColumn("_nb", bucket)
    counts = d.groupBy(*by, "_nb").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(*by).orderBy("_nb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0))).drop("_c")
    wl = Window.partitionBy(*by, "_nb").orderBy(*order)
    local = d.withColumn("_rl", F.row_number().over(wl))
    return local.join(offs, [*by, "_nb"]).withColumn(out, F.col("_off") + F.col("_rl")).drop("_nb", "_off", "_rl")
