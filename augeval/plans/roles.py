"""Role tables: each stands for one kind of input of the curation / evaluation work and is derived from the
driver's parquet tables with plain DataFrame expressions, so every query grows with the data. The same
derivations exist as DuckDB SQL in ``oracle_roles`` (values pass through decimal where text must agree).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augeval.functions.keys import md5_bucket
from augeval.session import load

# Fixed values of the role tables.
RANGE_LO, RANGE_HI = 1000.0, 100000.0          # inclusive range rule on obs values
SET_OF_FLAG = {"A": "real", "N": "generated", "R": "labeled"}
SPLIT_TEST_MAX, SPLIT_VAL_MAX = 10, 14         # md5 bucket: 0-9 test, 10-13 validation, the rest train
NOVEL_PARTS = 3                                # parts (l_partkey mod 10) whose synthetic rows spell one more token
PRICE_IN_PER_MTOK, PRICE_OUT_PER_MTOK, BATCH_FACTOR = 2, 10, 0.5


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (entity, value) observations: lineitem joined to its part.

    Tokens are the words of p_name, p_brand, p_type in lower case (only the name words when p_size % 5 = 0),
    plus the line status for the synthetic rows of some parts (entities that no measured row has), rotated left by
    l_linenumber modulo their count (two tokens stay). The raw spelling is upper case with
    doubled blanks for flag R. The value is the price as 2-decimal text, 'n/a' for some rows.
    """
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = li.join(part, li.l_partkey == part.p_partkey)
    words = F.split(F.lower("p_name"), " ")
    base = F.when(F.col("p_size") % 5 == 0, words).otherwise(
        F.concat(words, F.array(F.lower("p_brand"), F.lower("p_type"))))
    novel = (F.col("l_returnflag") != "A") & (F.col("l_partkey") % 10 < NOVEL_PARTS)
    base = F.when(novel, F.concat(base, F.array(F.lower("l_linestatus")))).otherwise(base)
    j = j.withColumn("_t", base).withColumn("_n", F.size("_t"))
    r = F.when(F.col("_n") == 2, F.lit(0)).otherwise(F.col("l_linenumber") % F.col("_n"))
    j = j.withColumn("_r", r)
    toks = F.concat(F.slice("_t", F.col("_r") + 1, F.col("_n") - F.col("_r")), F.slice("_t", F.lit(1), F.col("_r")))
    raw = F.when(F.col("l_returnflag") == "R", F.upper(F.array_join(toks, "  "))).otherwise(F.array_join(toks, " "))
    value_text = F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") == 0.1), F.lit("n/a")).otherwise(
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    # The spelling is made once a row: as a generated column, no filter on it or its keys is rewritten into these expressions
    # and moved below (where it was expanded and made several times over).
    return j.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.explode(F.array(raw)).alias("raw_key"), value_text.alias("value_text"),
        F.col("l_quantity").cast("int").alias("n_points"), F.col("l_returnflag").alias("reliability"),
        F.col("l_linestatus").alias("source"), F.col("p_type").alias("class"))


def split_of_bucket(bucket) -> F.Column:
    return F.when(bucket < SPLIT_TEST_MAX, "test").when(bucket < SPLIT_VAL_MAX, "validation").otherwise("train")


_LOG: dict[tuple, DataFrame] = {}


def log(spark: SparkSession, sf_dir: str, spread_rows: bool = True) -> DataFrame:
    """Response log: one record per request answer, with ids repeated over time (a retry log).

    Derived from events and written once per session (read by about 25 plans), so answer parsing reads a text
    column, as it would from a saved log."""
    from augeval.session import cut_lineage, spread
    memo = (spark.sparkContext.applicationId, sf_dir)
    if memo not in _LOG:
        _LOG[memo] = cut_lineage(_log(spark, sf_dir), "log")
    # answer parsing is CPU-heavy per row and a small log file is one scan split; streams keep the file order
    return spread(_LOG[memo]) if spread_rows else _LOG[memo]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"))
    v = F.col("value").cast("decimal(10,2)").cast("string")
    k = F.get_json_object("props", "$.k").cast("bigint")
    obj = lambda nm, val: F.concat(F.lit('{"smiles": "'), nm, F.lit('", "tg_celsius": '), val, F.lit("}"))
    m = F.col("event_id") % 5
    text = (F.when(m == 0, F.concat(F.lit("```json\n["), obj(name, v), F.lit(", "),
                                    obj(F.concat(name, F.lit(" b")), F.concat(F.lit('"'), k.cast("string"), F.lit('"'))),
                                    F.lit("]\n```")))
             .when(m == 1, F.concat(F.lit("Answer: "), obj(name, v)))
             .when(m == 2, obj(F.concat(F.lit("C\\C"), name), v))
             .when(m == 3, F.lit("I cannot give a reliable value for this one."))
             .otherwise(F.concat(F.lit("["), obj(name, v), F.lit(", 7]"))))
    batch = F.when(F.col("event_type") != "error", F.concat(F.lit("b"), F.date_format("ts", "yyyyMMdd")))
    out_tok = F.floor(F.col("value") * 10).cast("bigint")
    factor = F.when(batch.isNotNull(), F.lit(BATCH_FACTOR)).otherwise(F.lit(1.0))
    cost = ((k * PRICE_IN_PER_MTOK + out_tok * PRICE_OUT_PER_MTOK).cast("double") * factor / F.lit(1000000.0))
    return ev.select(
        F.format_string("req_%04d_%s", F.col("user_id"), F.col("event_type")).alias("custom_id"),
        F.col("event_id").alias("seq"), F.col("ts"), F.col("event_type").alias("task"),
        batch.alias("batch_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("model-a").alias("model"),
        F.when(F.col("value") > 200, "max_tokens").otherwise("end_turn").alias("stop_reason"),
        k.alias("input_tokens"), out_tok.alias("output_tokens"), cost.alias("cost_usd"), text.alias("text"))


_PREDS: dict[tuple, DataFrame] = {}


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions per (run, seed, entity): run = return flag, seed = line number, entity = part.

    An aggregate read by most evaluation plans, several times within one plan: materialized once per session."""
    from augeval.session import cut_lineage
    memo = (spark.sparkContext.applicationId, sf_dir)
    if memo not in _PREDS:
        li = load(spark, sf_dir, "lineitem")
        p = (li.groupBy(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("seed"),
                        F.col("l_partkey").alias("entity"))
               .agg(F.avg("l_extendedprice").alias("y_true"),
                    F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y_pred")))
        _PREDS[memo] = cut_lineage(p, "preds")
    return _PREDS[memo]


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-epoch training history: events of one user are the epochs of one run, in (ts, event_id) order."""
    from augeval.operators.sampling import number_within
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value",
                                              F.get_json_object("props", "$.k").cast("double").alias("test_mae"))
    # epochs numbered per run in (ts, event_id) order; day buckets keep a hot run out of one single window
    n = number_within(ev, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "epoch")
    return n.select(F.col("user_id").alias("run"), F.col("epoch").cast("int").alias("epoch"),
                    F.col("value").alias("val_mae"), "test_mae", F.col("event_type").alias("arm"), F.col("event_id"))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints as on-bit lists: positions (0-based) of the positive elements of each embedding."""
    emb = load(spark, sf_dir, "embeddings")
    on = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return emb.select(F.col("vec_id"), on.alias("bits"), F.col("label"),
                      (F.col("vec_id") % 5 == 0).alias("is_query"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where present."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left")
