"""Decontamination against held-out data under the either-key rule, and memorization measures.

Every either-key match is ONE equi-join on ``entity_id`` (see functions.keys): an OR of two key equalities
would plan a nested loop. Held-out id sets are distinct before joining; AQE turns the join into a broadcast
hash join when the measured side is small and keeps the shuffle join when it is not.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.functions.quantiles import with_quantiles
from augeval.functions.ranks import average_rank, guarded_corr


def decontaminate(df: DataFrame, held: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Remove rows whose entity matches any held-out row on either key (left anti join on the id)."""
    ids = held.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return df.join(ids, id_col, "left_anti")


def match_type(df: DataFrame, ref: DataFrame, exact_col: str = "exact_key", alt_col: str = "alt_key",
               ref_exact: str = "smiles", ref_alt: str = "alt_key", out: str = "match") -> DataFrame:
    """'exact' when the exact key is in the reference, else 'alt' when the alt key is, else null."""
    ex = ref.select(F.col(ref_exact).alias("_ke")).where(F.col("_ke").isNotNull()).distinct()
    al = ref.select(F.col(ref_alt).alias("_ka")).where(F.col("_ka").isNotNull()).distinct()
    j = (df.join(ex, F.col(exact_col) == F.col("_ke"), "left")
           .join(al, F.col(alt_col) == F.col("_ka"), "left"))
    m = F.when(F.col("_ke").isNotNull(), "exact").when(F.col("_ka").isNotNull(), "alt")
    return j.withColumn(out, m).drop("_ke", "_ka")


def memorization(syn: DataFrame, real: DataFrame, set_col: str = "synthetic_set", split_col: str = "split",
                 min_n: int = 3) -> DataFrame:
    """Per (synthetic set, real split, match kind incl. 'either'): n, percent of the set's unique entities, and
    for n >= min_n the MAE, median absolute error, Spearman and mean signed error of the synthetic values.

    ``syn``: set, entity_id, exact_key (its spelling), alt_key, value. ``real``: split, entity_id, smiles, alt_key, value.
    One match per (row, split): exact on the split's spellings wins over alt.
    """
    ref_ex = real.select(split_col, F.col("smiles").alias("_ke")).distinct()
    ref_al = real.select(split_col, F.col("alt_key").alias("_ka")).where(F.col("_ka").isNotNull()).distinct()
    ref_val = real.select(split_col, "entity_id", F.col("value").alias("real_value"))
    # exact / alt kinds per split: two equi-joins (split is part of both keys)
    ex = syn.join(ref_ex, F.col("exact_key") == F.col("_ke")).select(set_col, "entity_id", "value", split_col,
                                                                     F.lit("exact").alias("match"))
    al = (syn.join(ref_al, F.col("alt_key") == F.col("_ka"))
             .select(set_col, "entity_id", "value", split_col, F.lit("alt").alias("match"))
             .join(ex.select(set_col, "entity_id", split_col), [set_col, "entity_id", split_col], "left_anti"))
    kinds = ex.unionByName(al)
    both = kinds.unionByName(kinds.withColumn("match", F.lit("either")))
    m = both.join(ref_val, [split_col, "entity_id"])   # the real entity with the same id holds the real value
    m = m.withColumn("err", F.col("value") - F.col("real_value"))
    grp = [set_col, split_col, "match"]
    ranked = average_rank(average_rank(m, "value", grp, "_rx"), "real_value", grp, "_ry")
    stats = ranked.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("err")).alias("mae"),
        guarded_corr("_rx", "_ry").alias("spearman"), F.avg("err").alias("mean_signed_error"))
    stats = with_quantiles(stats, m.withColumn("_abs", F.abs("err")), "_abs", {"median_ae": 0.5}, grp)
    uniq = syn.groupBy(set_col).agg(F.count_distinct("entity_id").alias("_u"))
    big = F.col("n") >= min_n
    # every (set, split, kind) is reported, also those without a match
    kinds_of = F.explode(F.array(F.lit("exact"), F.lit("alt"), F.lit("either"))).alias("match")
    grid = uniq.withColumn("_one", F.lit(1)).join(real.select(split_col).distinct().withColumn("_one", F.lit(1)), "_one").select(
        set_col, "_u", split_col, kinds_of)
    out = grid.join(stats, grp, "left").withColumn("n", F.coalesce("n", F.lit(0))).select(
        *grp, "n", (F.col("n") * 100.0 / F.col("_u")).alias("percent_of_unique"),
        *[F.when(big, F.col(c)).alias(c) for c in ("mae", "median_ae", "spearman", "mean_signed_error")])
    return out


def any_match(df: DataFrame, ref: DataFrame, id_col: str = "entity_id", by: Sequence[str] = ()) -> DataFrame:
    """Count and share of the rows whose entity matches the union of all reference splits (left semi join)."""
    ids = ref.select(id_col).distinct()
    flagged = df.join(ids.withColumn("_hit", F.lit(1)), id_col, "left")
    return (flagged.groupBy(*by)
                   .agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("n_match"))
                   .withColumn("share", F.col("n_match") / F.col("n")))


def union_prefer_first(first: DataFrame, second: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """All rows of ``first`` plus the rows of ``second`` whose entity is not in ``first`` (either key)."""
    rest = decontaminate(second, first, id_col)
    return first.unionByName(rest, allowMissingColumns=True)


def split_leakage(df: DataFrame, id_col: str = "entity_id", split_col: str = "split") -> DataFrame:
    """Entities present in more than one split (must be empty)."""
    return (df.groupBy(id_col).agg(F.count_distinct(split_col).alias("n_splits"))
              .filter(F.col("n_splits") > 1))


def pairwise_intersect(df: DataFrame, id_col: str = "entity_id", split_col: str = "split") -> DataFrame:
    """Overlap size of each pair of splits: distinct (id, split), self-join on id with split order a < b.

    Pairs are formed per entity among its splits (a handful), never among rows."""
    d = df.select(id_col, split_col).distinct()
    a, b = d.alias("a"), d.alias("b")
    j = a.join(b, (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col(f"a.{split_col}") < F.col(f"b.{split_col}")))
    return j.groupBy(F.col(f"a.{split_col}").alias("split_a"), F.col(f"b.{split_col}").alias("split_b")).agg(
        F.count(F.lit(1)).alias("n_shared"))
