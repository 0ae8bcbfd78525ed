"""Registered plans: the Spark ML baseline. Model fits are iterative; the rows of every training set and the
grid have an oracle, the fitted metrics the rows-only check and property tests."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.operators import holdout, ml
from augeval.plans import stages
from augeval.plans.oracle_roles import with_roles
from augeval.plans.registry import query
from augeval.session import cut_lineage

# Fixed parameters of the ML plans (small forests).
TREES, DEPTH = 10, 8
SEEDS = [1, 2]
CONTROL = 250               # real rows of the small training sets
GRID_SIZES = [100, 250, None]
GRID_SEEDS = [1, 2, 3, 4, 5]
COLS = ["entity_id", "smiles", "value"]


def _data(spark, sf) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Real training rows, the decontaminated synthetic sets, and the test rows."""
    real = stages.real(spark, sf)
    held = real.filter(F.col("split").isin("test", "validation"))
    syn = holdout.decontaminate(stages.syn(spark, sf), held)
    sets = {k: syn.filter(F.col("synthetic_set") == k).select(*COLS) for k in ("generated", "labeled")}
    return real.filter(F.col("split") == "train").select(*COLS), sets, real.filter(F.col("split") == "test").select(*COLS)


def _tables(spark, sf):
    """The same, read several times by a grid: written once."""
    real, sets, test = _data(spark, sf)
    return cut_lineage(real, "ml-real"), {k: cut_lineage(v, f"ml-{k}") for k, v in sets.items()}, cut_lineage(test, "ml-test")


def _written(spark, sf):
    """The written tables and the features of every spelling."""
    real, sets, test = _tables(spark, sf)
    return real, sets, test, ml.features(_union([real, test, *sets.values()]))


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


_DEC = ("dec", "SELECT * FROM syn s WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.split IN ('test', 'validation') AND r.entity_id = s.entity_id)")
_SETS_SQL = f"""SELECT 'real_nfull' AS run, seed, entity_id FROM big
  UNION ALL SELECT 'real_n{CONTROL}', seed, entity_id FROM small
  UNION ALL SELECT 'synthetic_' || synthetic_set, seed, entity_id FROM dec, seeds
  UNION ALL SELECT 'concat_' || k || '_nfull', seed, entity_id FROM big, kinds
  UNION ALL SELECT 'concat_' || synthetic_set || '_nfull', seed, entity_id FROM dec, seeds
    WHERE NOT EXISTS (SELECT 1 FROM big b WHERE b.seed = seeds.seed AND b.entity_id = dec.entity_id)
  UNION ALL SELECT 'concat_' || k || '_n{CONTROL}', seed, entity_id FROM small, kinds
  UNION ALL SELECT 'concat_' || synthetic_set || '_n{CONTROL}', seed, entity_id FROM dec, seeds
    WHERE NOT EXISTS (SELECT 1 FROM small b WHERE b.seed = seeds.seed AND b.entity_id = dec.entity_id)"""
_SETS_EXTRA = [_DEC, ("seeds", "SELECT * FROM (VALUES " + ", ".join(f"({s})" for s in SEEDS) + ") s(seed)"),
               ("kinds", "SELECT DISTINCT synthetic_set AS k FROM dec"),
               ("big", "SELECT seed, entity_id FROM real, seeds WHERE split = 'train'"),
               ("small", f"SELECT seed, entity_id FROM big QUALIFY row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || entity_id), entity_id) <= {CONTROL}")]


@query("training_sets", with_roles(f"""
  SELECT run, CAST(seed AS INTEGER) AS seed, count(*) AS n_train, (SELECT count(*) FROM real WHERE split = 'test') AS n_test
  FROM ({_SETS_SQL}) GROUP BY run, seed
""", "real", "syn", extra=_SETS_EXTRA))
def q_training_sets(spark, sf):
    """M2's grid before the fits: training and test rows of each of the eight sets and seeds."""
    real, sets, test = _tables(spark, sf)
    runs = [df.agg(F.count(F.lit(1)).alias("n_train")).select(F.lit(k).alias("run"), F.lit(seed).alias("seed"), "n_train")
            for seed in SEEDS for k, df in ml.training_sets(real, sets, CONTROL, seed).items()]
    return _union(runs).withColumn("n_test", test.select(F.count(F.lit(1))).scalar())


@query("forest_fit_eval")
def q_forest_fit_eval(spark, sf):
    """M2: a forest per training set of the published grid and seed, metrics on the one test split."""
    real, sets, test, feats = _written(spark, sf)
    runs = [(k, seed, df) for seed in SEEDS for k, df in ml.training_sets(real, sets, CONTROL, seed).items()]
    return ml.grid_metrics(ml.run_grid(runs, feats, test, TREES, DEPTH))


@query("experiment_grid", with_roles("""
  SELECT train_set, coalesce(CAST(size AS VARCHAR), 'full') AS size, seed, least(coalesce(size, set_rows), set_rows) AS n_train_rows
  FROM sz, (VALUES (100), (250), (NULL)) s(size), (VALUES (1), (2), (3), (4), (5)) d(seed)
""", "real", "syn", extra=[
    _DEC, ("sz", """SELECT 'real' AS train_set, count(*) AS set_rows FROM real WHERE split = 'train'
              UNION ALL SELECT synthetic_set, count(*) FROM dec GROUP BY synthetic_set
              UNION ALL SELECT 'real+generated', (SELECT count(*) FROM real WHERE split = 'train') + count(*) FROM dec
                WHERE synthetic_set = 'generated' AND entity_id NOT IN (SELECT entity_id FROM real WHERE split = 'train')""")]))
def q_experiment_grid(spark, sf):
    """M3: the run table: training set x size x seed with the training rows of each run."""
    real, sets, _ = _data(spark, sf)
    named = {"real": real, **sets, "real+generated": holdout.union_prefer_first(real, sets["generated"])}
    sizes = _union([df.agg(F.count(F.lit(1)).alias("set_rows")).select(F.lit(k).alias("train_set"), "set_rows") for k, df in named.items()])
    return ml.experiment_grid(sizes, GRID_SIZES, GRID_SEEDS)


@query("pseudo_label")
def q_pseudo_label(spark, sf):
    """M4: a forest fit on the small real set labels the labeled set's spellings anew; students are fit on those labels, alone and
    with the real rows."""
    real, sets, test, feats = _written(spark, sf)
    runs = []
    for seed in SEEDS:
        small = ml.first_rows(real, CONTROL, seed)
        teacher = ml.fit(ml.packed(small.join(feats, "smiles"), CONTROL), TREES, DEPTH, seed)
        labels = cut_lineage(ml.pseudo_labeled(sets["labeled"], teacher, feats).select(*COLS), "pseudo-labels")
        runs += [("teacher", seed, small), ("selftrain", seed, labels), ("concat_selftrain", seed, holdout.union_prefer_first(small, labels))]
    return ml.grid_metrics(ml.run_grid(runs, feats, test, TREES, DEPTH))


@query("learning_curve")
def q_learning_curve(spark, sf):
    """M5: test MAE by number of real rows (nested subsets) and training set (real only, in two stages from each synthetic set), mean
    and SD over seeds."""
    real, sets, test, feats = _written(spark, sf)
    return ml.learning_curve(real, sets, feats, test, [n for n in GRID_SIZES if n], SEEDS, TREES, DEPTH)


@query("label_shuffle_control")
def q_label_shuffle_control(spark, sf):
    """M6: forests on each synthetic set against forests on the same set with its labels permuted over its entities."""
    _, sets, test, feats = _written(spark, sf)
    runs = [(k, seed, df) for seed in SEEDS for k, df in ({f"true_{n}": d for n, d in sets.items()} | ml.shuffled_sets(sets, seed)).items()]
    return ml.grid_metrics(ml.run_grid(runs, feats, test, TREES, DEPTH))
