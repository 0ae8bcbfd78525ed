"""Resampling by a tree of binomial splits: every draw is dealt, shares have the right mean and spread, intervals near the usual bootstrap."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from augeval.operators.bootstrap import bootstrap_ci, leaf_draws, paired_bootstrap


def test_draws_are_dealt_in_proportion(spark):
    sizes, leaf, resamples = {"a": 1000, "b": 37, "c": 1, "d": 64}, 16, 300
    got = leaf_draws(spark.createDataFrame(list(sizes.items()), "g string, n long"), resamples, 5, ["g"], leaf).collect()
    total, by_leaf = {}, {}
    for r in got:
        assert r.size == min(leaf, sizes[r.g] - r.leaf * leaf) and r.draws > 0
        total[r.g, r.b] = total.get((r.g, r.b), 0) + r.draws
        by_leaf.setdefault((r.g, r.leaf), []).append(r.draws)
    assert total == {(g, b): n for g, n in sizes.items() for b in range(1, resamples + 1)}
    for (g, i), draws in by_leaf.items():
        n, size = sizes[g], min(leaf, sizes[g] - i * leaf)
        draws = np.array(draws + [0] * (resamples - len(draws)))
        sd = np.sqrt(size * (1 - size / n)) if size < n else 0   # binomial(n, size / n)
        assert abs(draws.mean() - size) <= 5 * sd / np.sqrt(resamples)
        assert size == n or 0.75 * sd < draws.std() < 1.3 * sd


def test_interval_near_the_usual_bootstrap(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(3, 1500)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    r = bootstrap_ci(d, "id", "v", 600, 7).first()
    m = np.array([rng.choice(x, len(x)).mean() for _ in range(600)])
    sd = x.std() / np.sqrt(len(x))
    assert r["mean"] == pytest.approx(x.mean())
    assert [r.ci_lo, r.ci_hi] == pytest.approx(list(np.quantile(m, [0.025, 0.975])), abs=0.4 * sd)


def test_groups_share_their_draws_and_missing_entities_count_not(spark):
    rng = np.random.default_rng(3)
    ref = [(i, float(rng.normal(10, 1))) for i in range(700)]
    runs = [(s, i, v + 0.3 + float(rng.normal(0, 1))) for s in (1, 2) for i, v in ref if s == 1 or i % 3]
    d = spark.createDataFrame(runs + [(3, i, v) for _, i, v in runs if _ == 1], "seed long, id long, e double")
    rows = {r.seed: r for r in paired_bootstrap(d, spark.createDataFrame(ref, "id long, e double"), "id", ["seed"], "e", 400, 1).collect()}
    assert rows[1].excludes_zero and (rows[1].ci_lo, rows[1].ci_hi) == (rows[3].ci_lo, rows[3].ci_hi)
    assert rows[2].ci_hi - rows[2].ci_lo == pytest.approx((rows[1].ci_hi - rows[1].ci_lo) * np.sqrt(1.5), rel=0.3)


def test_no_table_of_all_draws(spark):
    n, resamples = 5000, 50
    counts = leaf_draws(spark.createDataFrame([(n,)], "n long"), resamples, 1)
    assert counts.count() <= resamples * -(-n // 256) and counts.agg(F.sum("draws")).first()[0] == n * resamples


def test_hashed_draws_follow_the_contract_and_are_no_expression_a_draw(spark):
    import hashlib
    word = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:15], 16)
    values = {i: float(i * i % 97) for i in range(40)}          # one leaf: a draw is floor(u * 40 / 2**60)
    values[5] = None
    order = sorted(values, key=lambda i: (hashlib.md5(f"3|{i}".encode()).hexdigest(), i))
    means = []
    for b in range(1, 21):
        drawn = [values[order[word(3, "leaf", b, 0, j) * 40 >> 60]] for j in range(1, 41)]
        means.append(np.mean([x for x in drawn if x is not None]))
    d = spark.createDataFrame(list(values.items()), "id long, v double")
    df = bootstrap_ci(d, "id", "v", 20, 3)
    r = df.first()
    assert [r.ci_lo, r.ci_hi] == pytest.approx(list(np.quantile(means, [0.025, 0.975])))
    assert "conv(" not in df._jdf.queryExecution().optimizedPlan().toString()   # before: a chain of expressions a draw


def test_weights_of_a_leaf_are_hashed_once_for_all_groups(spark, monkeypatch):
    from augeval.operators import bootstrap
    calls = spark.sparkContext.accumulator(0)
    plain = bootstrap._weights

    def counted(*args):
        calls.add(1)
        return plain(*args)
    monkeypatch.setattr(bootstrap, "_weights", counted)
    ref = [(i, float(i % 13)) for i in range(600)]              # three leaves
    d = spark.createDataFrame([(s, i, v + s) for s in range(20) for i, v in ref], "seed long, id long, e double")
    assert paired_bootstrap(d, spark.createDataFrame(ref, "id long, e double"), "id", ["seed"], "e", 10, 1).count() == 20
    assert 3 <= calls.value <= 6   # before: hashed for each of 60 leaves of groups


def test_poisson_weights_by_row_and_resample(spark):
    import hashlib
    from augeval.operators.bootstrap import POISSON1_CDF, poisson_bootstrap
    rows = [("a", i, float(i % 7)) for i in range(60)] + [("b", 3, None), ("b", None, 2.0), (None, 4, 5.0), ("c", 1, None)]
    d = spark.createDataFrame(rows, "g string, id long, v double")
    df = poisson_bootstrap(d, "id", "v", 15, 9, by=["g"])
    weight = lambda b, i: sum(c <= int(hashlib.md5("|".join(["9", str(b)] + ([] if i is None else [str(i)])).encode()).hexdigest()[:15], 16) / 16 ** 15 for c in POISSON1_CDF)
    m = []
    for b in range(1, 16):
        w = [(weight(b, i), v) for g, i, v in rows if g == "a"]
        m.append(sum(x * v for x, v in w) / sum(x for x, _ in w))
    got = {r.g: r for r in df.collect()}
    assert [got["a"].ci_lo, got["a"].ci_hi] == pytest.approx(list(np.quantile(m, [0.025, 0.975])))
    assert got["c"].ci_lo is None and got["b"].mean == 2.0
    assert "explode" not in df._jdf.queryExecution().analyzed().toString()   # before: a row for each row and resample
