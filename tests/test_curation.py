"""Match kinds, either-key merge, decontamination and funnel invariants."""
from pyspark.sql import functions as F

from augeval.functions.keys import with_keys
from augeval.operators import curate, holdout
from augeval.plans import stages


def test_match_kinds(spark):
    ref = with_keys(spark.createDataFrame([("c c o",), ("a b",)], "raw string"), "raw").withColumnRenamed("exact_key", "smiles")
    q = with_keys(spark.createDataFrame([("c c o",), ("o c c",), ("x y z",), ("a b",)], "raw string"), "raw")
    m = {r["raw"]: r["match"] for r in holdout.match_type(q, ref).collect()}
    assert m == {"c c o": "exact", "o c c": "alt", "x y z": None, "a b": "exact"}


def test_merge_median_over_either_key(spark):
    rows = [("c c o", -50.0), ("o c c", -70.0), ("o c c", -60.0), ("c c", 10.0)]
    df = with_keys(spark.createDataFrame(rows, "raw string, value double"), "raw")
    out = {r["smiles"]: r["value"] for r in curate.merge_duplicates(df).collect()}
    assert out == {"c c o": -60.0, "c c": 10.0}


def test_decontaminated_disjoint_from_held_out(spark, sf):
    real = stages.real(spark, sf)
    held = real.filter(F.col("split").isin("test", "validation"))
    clean = holdout.decontaminate(stages.syn(spark, sf), held)
    assert clean.join(held.select("entity_id"), "entity_id").count() == 0


def test_funnel_monotone_and_counts_recount(spark, sf):
    from augeval.plans.registry import QUERIES, load_all
    load_all()
    f = {(r["synthetic_set"], r["step"]): r["n"] for r in QUERIES["cleaning_funnel"](spark, sf).collect()}
    for s in ("generated", "labeled"):
        seq = [f[(s, k)] for k in ("raw", "number", "key", "markers", "fragment", "range")]
        assert seq == sorted(seq, reverse=True)
        assert f[(s, "distinct_entities")] <= f[(s, "distinct_keys")]
        assert f[(s, "after_test")] + f[(s, "test_exact")] + f[(s, "test_alt")] == f[(s, "distinct_entities")]
    recount = stages.syn(spark, sf).filter(F.col("synthetic_set") == "generated").count()
    assert recount == f[("generated", "distinct_entities")]


def test_split_leakage_empty(spark, sf):
    assert holdout.split_leakage(stages.real(spark, sf)).count() == 0


def test_merge_of_lists(spark):
    """The value is the median of the rows' values; the measurements give number and SD; an empty list keeps its entity."""
    from augeval.operators.curate import merge_measurements
    rows = [("e", "k", 10.0, 1, "a", "c", [10.0, 11.0]), ("e", "k", 20.0, 1, "b", "c", [20.0, 50.0]), ("f", "k", 1.0, 1, "a", "c", [])]
    d = spark.createDataFrame(rows, "entity_id string, exact_key string, value double, n_points int, source string, class string, values array<double>")
    got = {r["entity_id"]: r for r in merge_measurements(d).collect()}
    assert got["e"]["value"] == 15.0 and got["e"]["n_values"] == 4 and got["f"]["value"] == 1.0 and got["f"]["n_values"] == 0


def test_standardize_constant_group_and_histogram_of_nothing(spark):
    from augeval.operators.evaluate import standardize
    from augeval.operators.metrics import dense_histogram
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, y double")
    assert [r["z"] for r in standardize(d, ["g"], "y").where("g = 'a'").collect()] == [None, None]
    assert {r["n"] for r in dense_histogram(d.where("y > 99"), "y", [0.0, 1.0, 2.0]).collect()} == {0}


def test_early_stop_counts_steps_not_epochs(spark):
    from augeval.operators.paired import early_stop
    d = spark.createDataFrame([(1, e, v, 10.0 * e) for e, v in ((1, 3.0), (4, 4.0), (5, 4.0), (6, 2.0), (7, 9.0))], "run long, epoch long, m double, t double")
    r = early_stop(d, ["run"], "epoch", "m", 3, carry=["t"]).first()
    assert (r["best_epoch"], r["best_t"], r["steps_run"]) == (6, 60.0, 7)
