"""Shared stages of the registered plans (lazy DataFrames; nothing is collected)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from augeval.functions.keys import add_cycle_key, md5_bucket, numeric_or_null, with_keys
from augeval.operators import curate
from augeval.plans import roles
from augeval.plans.roles import RANGE_HI, RANGE_LO, split_of_bucket
from augeval.session import cut_lineage


def round_doubles(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round every floating column (and floating array) half-even; the oracle SQL rounds the same columns."""
    def rnd(f):
        if isinstance(f.dataType, (DoubleType, FloatType)):
            return F.bround(F.col(f.name).cast("double") + F.lit(nudge), digits).alias(f.name) if nudge else \
                F.bround(F.col(f.name).cast("double"), digits).alias(f.name)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (DoubleType, FloatType)):
            return F.transform(f.name, lambda x: F.bround(x.cast("double") + F.lit(nudge), digits)).alias(f.name)
        return F.col(f.name)
    return df.select(*[rnd(f) for f in df.schema.fields])


_KEYED: dict[tuple, DataFrame] = {}


def obs_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs with exact_key, alt_key, entity_id and the numeric value (null when not numeric).

    Materialized once per session with a reliable checkpoint in the shared checkpoint folder: the keys are
    read by every later stage.
    """
    memo = (spark.sparkContext.applicationId, sf_dir)
    if memo not in _KEYED:
        o = roles.obs(spark, sf_dir)
        # keys where the row is read: no shuffle of the spellings, none of the rows by their spelling
        o = with_keys(o, "raw_key").withColumn("value", numeric_or_null("value_text"))
        _KEYED[memo] = cut_lineage(o, "obs-keyed")
    return _KEYED[memo]


def obs_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules 1-4: numeric value, valid key, value in range."""
    o = obs_keyed(spark, sf_dir)
    o = curate.valid(o.filter(F.col("value").isNotNull()), "exact_key")
    return curate.between(o, "value", RANGE_LO, RANGE_HI)


_MERGED: dict[tuple, DataFrame] = {}


def merged_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule 5 for every flag, with the spelling's alt key and the split bucket of measured entities.

    One row per (flag, entity); materialized once per session (read by the real, synthetic, funnel, holdout and
    memorization plans, several times within one plan)."""
    memo = (spark.sparkContext.applicationId, sf_dir)
    if memo not in _MERGED:
        v = obs_valid(spark, sf_dir).withColumnRenamed("reliability", "flag")
        m = curate.merge_duplicates(v, "entity_id", "exact_key", "value", by=["flag"])
        m = add_cycle_key(m.repartition(2 * spark.sparkContext.defaultParallelism), "smiles", "alt_key")
        m = m.withColumn("split", F.when(F.col("flag") == "A", split_of_bucket(md5_bucket("entity_id"))))
        _MERGED[memo] = cut_lineage(m, "merged")
    return _MERGED[memo]


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule 5: one row per (flag, entity) with the smallest spelling and the median value."""
    return merged_keyed(spark, sf_dir).select("flag", "entity_id", "smiles", "value")


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured set with its splits: every flag A entity."""
    m = merged_keyed(spark, sf_dir).filter((F.col("flag") == "A") & F.col("split").isNotNull())
    return m.select("entity_id", "smiles", "value", "alt_key", "split")


def syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two synthetic sets after rules 1-5."""
    m = merged_keyed(spark, sf_dir).filter(F.col("flag").isin("N", "R"))
    return m.select(F.when(F.col("flag") == "N", "generated").otherwise("labeled").alias("synthetic_set"),
                    "entity_id", "smiles", "value")


def syn_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic merged entities with their spelling's keys (exact_key = smiles, alt_key = its cycle key)."""
    m = merged_keyed(spark, sf_dir).filter(F.col("flag").isin("N", "R"))
    return m.select(F.when(F.col("flag") == "N", "generated").otherwise("labeled").alias("synthetic_set"),
                    "entity_id", "smiles", "value", F.col("smiles").alias("exact_key"), "alt_key")
