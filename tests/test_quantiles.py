"""Exact quantiles by selection: against numpy, on groups of every kind; no buffer of a group's values in the plans."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from augeval.functions.quantiles import quantiles, with_quantiles
from augeval.plans.registry import QUERIES, load_all

load_all()
QS = {"q00": 0.0, "q05": 0.05, "q50": 0.5, "q99": 0.99, "q100": 1.0}


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"wide": rng.normal(0, 1e6, 30_000), "ties": rng.integers(0, 5, 9_000) / 4, "one": np.array([7.5]), "two": np.array([1.0, 2.0]),
              None: rng.normal(0, 1, 501), "hot": np.concatenate([np.zeros(20_000), rng.normal(0, 1, 4_000)])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("two", None), ("none", None)]
    d = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in quantiles(d, "x", QS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert [got[g][c] for c in QS] == pytest.approx([np.quantile(v, q) for q in QS.values()], rel=1e-12, abs=1e-12)
    whole = np.concatenate(list(groups.values()))
    one = quantiles(d, "x", QS).collect()
    assert len(one) == 1 and list(one[0]) == pytest.approx([np.quantile(whole, q) for q in QS.values()], rel=1e-12)
    beside = {r.g: (r.n, r.q50) for r in with_quantiles(d.groupBy("g").agg(F.count("x").alias("n")), d, "x", {"q50": 0.5}, ["g"]).collect()}
    assert beside["none"] == (0, None) and beside[None][1] == pytest.approx(float(np.median(groups[None])))


def test_empty_table(spark):
    d = spark.createDataFrame([], "g string, x double")
    assert quantiles(d, "x", QS, ["g"]).count() == 0
    assert [tuple(r) for r in quantiles(d, "x", QS).collect()] == [(None,) * 5]


@pytest.mark.parametrize("name", ["distribution_stats", "repeat_spread", "noise_floor", "median_error_by_band", "quantile_summary", "memorization"])
def test_no_buffer_of_a_group(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


@pytest.mark.parametrize("name", ["running_total", "distinct_curve"])
def test_prefix_sums_have_no_single_partition(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
