"""The forest grid on a learnable table: sets as published, shuffled labels do worse, a repeated seed gives the same metrics."""
import pytest
from pyspark.sql import functions as F

from augeval.operators import ml

COLS = "entity_id string, smiles string, value double"


@pytest.fixture(scope="module")
def tables(spark):
    import random
    r = random.Random(4)
    words = {w: r.uniform(-50, 50) for w in "abcdefghij"}

    def rows(n, tag, shift=0.0):
        out = []
        for i in range(n):
            t = [r.choice(list(words)) for _ in range(4)]
            out.append((f"{tag}{i}", " ".join(t), sum(words[w] for w in set(t)) + shift + r.gauss(0, 1)))
        return out
    real, gen, lab, test = (spark.createDataFrame(x, COLS) for x in (rows(200, "r"), rows(150, "g", 5), rows(150, "l", -5), rows(100, "t")))
    gen = gen.union(real.limit(10))   # entities of both: the real row wins
    sets = {"generated": gen, "labeled": lab}
    return real, sets, test, ml.features(real.union(gen).union(lab).union(test))


def test_published_sets(tables):
    real, sets, _, _ = tables
    got = {k: df.count() for k, df in ml.training_sets(real, sets, 50, 1).items()}
    again = {k: df.count() for k, df in ml.training_sets(real, sets, 50, 1).items()}
    assert got == again and set(got) == {"real_nfull", "real_n50", "synthetic_generated", "synthetic_labeled", "concat_generated_nfull",
                                         "concat_labeled_nfull", "concat_generated_n50", "concat_labeled_n50"}
    assert got["real_n50"] == 50 and got["concat_generated_nfull"] == 350 and got["concat_labeled_nfull"] == 350
    assert 200 <= got["concat_generated_n50"] <= 210


def test_grid_metrics(tables):
    real, sets, test, feats = tables
    shuffled = ml.shuffled_sets(sets, 3)
    assert sorted(r.value for r in shuffled["shuffled_labeled"].collect()) == sorted(r.value for r in sets["labeled"].collect())
    runs = [("real", 1, real), ("real", 2, real), ("again", 1, real), ("small", 1, ml.first_rows(real, 20, 1)),
            ("true", 1, sets["labeled"]), ("shuffled", 1, shuffled["shuffled_labeled"])]
    m = {(r.run, r.seed): r for r in ml.grid_metrics(ml.run_grid(runs, feats, test, 5, 6)).collect()}
    assert len(m) == 6 and all(r.n_test == 100 for r in m.values()) and m["small", 1].n_train == 20 and m["real", 1].n_train == 200
    assert m["again", 1].mae == pytest.approx(m["real", 1].mae) and m["again", 1].spearman == pytest.approx(m["real", 1].spearman)
    assert m["real", 1].mae < m["small", 1].mae and m["true", 1].mae < 0.8 * m["shuffled", 1].mae and m["true", 1].spearman > 0.5


def test_pseudo_labels_are_the_teachers(tables):
    real, sets, _, feats = tables
    teacher = ml.fit(real.join(feats, "smiles"), 5, 6, 1)
    rows = ml.pseudo_labeled(sets["labeled"], teacher, feats)
    assert rows.columns and rows.count() == sets["labeled"].count()
    own = {r.entity_id: r.value for r in sets["labeled"].collect()}
    assert sum(abs(r.value - own[r.entity_id]) > 1e-9 for r in rows.collect()) > 140   # not the set's own labels


def test_a_fit_has_no_more_partitions_than_its_rows_need(tables, monkeypatch):
    real, _, test, feats = tables
    assert ml.packed(real.repartition(8), 200).rdd.getNumPartitions() == 1
    assert ml.packed(real.repartition(8), 25_000).rdd.getNumPartitions() == 3
    cores = real.sparkSession.sparkContext.defaultParallelism
    assert ml.packed(real.repartition(2 * cores), 10 ** 9).rdd.getNumPartitions() == cores
    seen, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda train, *a, **k: seen.append(train.rdd.getNumPartitions()) or fit(train, *a, **k))
    spread = real.sparkSession.createDataFrame(real.repartition(8).rdd, real.schema).hint("shuffle_merge")
    assert ml.run_grid([("spread", 1, spread)], feats.hint("broadcast"), test, 2, 3).count() == 100
    assert seen == [1]


def test_learning_curve_has_the_two_stage_sets(tables, monkeypatch):
    real, sets, test, feats = tables
    fitted, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda train, *a, **k: fitted.append(train.count()) or fit(train, *a, **k))
    empty = {"none": sets["labeled"].limit(0)}
    got = {(r.train_set, r.subset): r for r in ml.learning_curve(real, sets | empty, feats, test, [20, 60], [1, 2], 5, 6).collect()}
    assert set(got) == {(s, n) for s in ("real", "twostage_generated", "twostage_labeled") for n in ("n20", "n60", "full")}
    assert all(r.n_seeds == 2 and r.mae_sd >= 0 for r in got.values())
    # a set's first stage is fit once a seed, the three curves on the same nested subsets
    assert sorted(fitted) == sorted(2 * ([160, 150] + 3 * [20, 60, 200]))
    assert got["real", "full"].mae_mean < got["real", "n20"].mae_mean
    assert got["twostage_labeled", "n20"].mae_mean < got["real", "n20"].mae_mean


def test_a_second_stage_starts_at_the_first(tables):
    real, sets, test, feats = tables
    train, held = sets["labeled"].join(feats, "smiles"), test.join(feats, "smiles")
    first = ml.fit(train, 5, 6, 1)
    at_first = {r.entity_id: r.prediction for r in first.transform(held).collect()}
    # rows that the first stage is off by 7 at, each: the second one moves every prediction by 7
    moved = first.transform(train).select("features", (F.col("prediction") + 7).alias("value"))
    rows = ml.second_stage(moved, held, first, 5, 6, 1).collect()
    assert len(rows) == 100 and all(r.prediction == pytest.approx(at_first[r.entity_id] + 7) for r in rows)
