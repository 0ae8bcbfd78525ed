"""The corpus pipeline: quality classifier, near-duplicate join, repeated passages, source mixing, byte-level BPE.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augeval.session import cut_lineage, load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_LABEL_FOLDS = 5      # labels of documents whose crc32(doc_id) mod 5 is 0 are never learned from
QUALITY_THRESHOLD = 0.3      # documents scored below it go
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: drop the documents that the quality classifier scores below the threshold. The model learns from the
    labelled documents that are still there."""
    from augeval.llm.quality import score, train
    model = train(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("score") >= QUALITY_THRESHOLD).select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: one document of each group linked at Jaccard 0.8 of five-word shingles stays, the one with the smallest id
    (of rows that repeat an id, each is judged by its own text, and one row of a group stays). Documents without words or
    without an id stay."""
    from augeval.llm.jaccard_join import link_components, with_set_key
    groups = cut_lineage(link_components(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN), "near-groups").where("doc_id is not null and n_shingles > 0")
    if groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(groups.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    # The rows of a group that hold its smallest id: one set of them stays, and one row of those.
    low = groups.where("component_id = doc_id").groupBy("group_key").agg(F.min("set_key").alias("low"))
    gone = groups.join(low, "group_key").where("component_id <> doc_id or set_key <> low").select("doc_id", "set_key").distinct()
    kept = with_set_key(docs.select(*COLUMNS), NEAR_WORDS).join(gone, ["doc_id", "set_key"], "left_anti")
    again = groups.groupBy("doc_id", "set_key").count().where("count > 1").select("doc_id", "set_key")
    first = kept.join(again, ["doc_id", "set_key"], "left_semi").groupBy("doc_id", "set_key").agg(
        F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(again, ["doc_id", "set_key"], "left_anti").select(*COLUMNS).unionByName(first.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: every passage of 50 words or more that stands earlier in the corpus is cut out of the text."""
    from augeval.llm.suffix_dedup import cut_passages
    return cut_passages(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents in the order of the mixing schedule (files follow the slots of the schedule). The schedule derives from
    doc_id, source and the other columns alone, so that stage 5 finds the same one in the rows read again."""
    from augeval.llm.mixing import schedule
    return schedule(docs).orderBy("slot", "place").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: token ids and their byte offsets, checked by decoding them again, with the source, block, slot and place of the
    document in the mixing schedule."""
    from augeval.llm.bpe import digests
    from augeval.llm.mixing import schedule
    mixed = schedule(docs.select(*COLUMNS)).select("doc_id", "text", "source", "block", "slot", "place")
    return digests(mixed, keep=["source", "block", "slot", "place"])


STAGES = [("quality_classifier", keep_good), ("ngram_jaccard_join", keep_one_of_group), ("suffix_array_dedup", cut_repeats),
          ("source_mixing", mix), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier, the near-copy groups and the tokenizer have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None
