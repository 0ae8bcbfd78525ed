"""Exact, seeded, reproducible splits and samples."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from augeval.functions.keys import seeded_hash
from augeval.operators import sampling


def ids(spark, n):
    return spark.range(n).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("eid"),
                                 (F.col("id") * 1.5).alias("value"))


def test_number_by_equals_row_number(spark):
    df = ids(spark, 700).withColumn("h", seeded_hash(3, "eid"))
    a = sampling.number_by(df, "h", ["eid"], "rn", prefix_chars=2)
    b = df.withColumn("rn2", F.row_number().over(Window.orderBy("h", "eid")))
    assert a.join(b, "eid").filter(F.col("rn") != F.col("rn2")).count() == 0


def test_seeded_split_exact_sizes_and_disjoint(spark):
    df = ids(spark, 1001)
    s = sampling.seeded_split(df, "eid", 42)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    n_test = round(1001 * 0.2)
    assert counts["test"] == n_test and counts["validation"] == round((1001 - n_test) * 0.1)
    assert sum(counts.values()) == 1001 and s.select("eid").distinct().count() == 1001
    again = sampling.seeded_split(df, "eid", 42)
    assert s.exceptAll(again).count() == 0


def test_nested_subsets_are_nested(spark):
    n = sampling.nested_subsets(ids(spark, 300), "eid", 7, [10, 50, 100])
    sets = {k: {r["eid"] for r in n.filter(F.col("subset") == k).collect()} for k in ("n10", "n50", "n100", "full")}
    assert sets["n10"] <= sets["n50"] <= sets["n100"] <= sets["full"]
    assert [len(sets[k]) for k in ("n10", "n50", "n100", "full")] == [10, 50, 100, 300]


def test_shuffle_keeps_multiset(spark):
    df = ids(spark, 200)
    s = sampling.shuffle_labels(df, "eid", "value", 42)
    assert sorted(r["value"] for r in s.collect()) == sorted(r["shuffled"] for r in s.collect())
    assert s.filter(F.col("value") != F.col("shuffled")).count() > 150


def test_distinct_sample_size(spark):
    df = ids(spark, 100).unionByName(ids(spark, 100))
    assert sampling.distinct_sample(df, ["eid"], 30, 1).count() == 30
    assert sampling.distinct_sample(df, ["eid"], 500, 1).count() == 100
