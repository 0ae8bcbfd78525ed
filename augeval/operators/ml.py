"""A Spark ML baseline: random forests over hashed token n-gram features of the entity spelling, a grid of training sets and seeds.

Features are computed once per spelling and written; every run joins them to its (entity, spelling, label) rows. Fits are jobs of a
few threads, so the cluster works on several at once; a run's training rows are released when its predictions are written."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import HashingTF
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augeval.operators.holdout import union_prefer_first
from augeval.operators.metrics import regression_metrics, run_summary
from augeval.operators.sampling import nested_subsets, seeded_order, shuffle_labels
from augeval.operators.similarity import add_ngrams, add_tokens
from augeval.session import cut_lineage, scratch_path

PARALLEL = 4   # fits at a time
FIT_ROWS = 10_000   # training rows that a partition holds at least


def features(spellings: DataFrame, text_col: str = "smiles", radius: int = 2, bits: int = 2048) -> DataFrame:
    """(spelling, features): binary hashed n-grams (up to radius + 1 tokens) of every distinct spelling, a written table."""
    d = spellings.select(text_col).distinct()
    d = add_ngrams(add_tokens(d, text_col), "_tokens", radius + 1, out="_grams")
    tf = HashingTF(inputCol="_grams", outputCol="features", numFeatures=bits, binary=True)
    return cut_lineage(tf.transform(d).select(text_col, "features"), "forest-features")


def fit(train: DataFrame, trees: int, depth: int, seed: int, label: str = "value") -> RandomForestRegressionModel:
    """A forest trying every feature at every split (as the reference's); Spark caps the depth at 30, the reference grows
    trees without a limit."""
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", numTrees=trees,
                                 maxDepth=depth, featureSubsetStrategy="all", seed=seed).fit(train)


def packed(train: DataFrame, n: int) -> DataFrame:
    """n training rows in no more partitions than they need. Every partition shuffles the statistics of all nodes, features and trees of a
    level, however few its rows are, so a fit's shuffle grows with the partitions."""
    return train.coalesce(max(1, min(-(-n // FIT_ROWS), train.sparkSession.sparkContext.defaultParallelism)))


def first_rows(real: DataFrame, n: int, seed: int, id_col: str = "entity_id") -> DataFrame:
    """The first n rows of the seeded order (the subset that nested subsets of this seed share)."""
    chosen = seeded_order(real.select(id_col), id_col, seed, "_p").where(F.col("_p") <= n).select(id_col)
    return real.join(chosen, id_col)


def training_sets(real: DataFrame, synthetic: dict[str, DataFrame], n: int, seed: int) -> dict[str, DataFrame]:
    """The published grid of one seed: all real rows, each synthetic set, both together (real rows win), and the same with the first
    n real rows only."""
    small = first_rows(real, n, seed)
    sets = {"real_nfull": real, f"real_n{n}": small}
    for name, df in synthetic.items():
        sets |= {f"synthetic_{name}": df, f"concat_{name}_nfull": union_prefer_first(real, df), f"concat_{name}_n{n}": union_prefer_first(small, df)}
    return sets


def shuffled_sets(synthetic: dict[str, DataFrame], seed: int, label: str = "value") -> dict[str, DataFrame]:
    """Each synthetic set with its labels permuted over its entities, fixed by the seed."""
    return {f"shuffled_{name}": shuffle_labels(df, "entity_id", label, seed).drop(label).withColumnRenamed("shuffled", label)
            for name, df in synthetic.items()}


@contextmanager
def _train_rows(rows: DataFrame, feats: DataFrame, text_col: str, label: str) -> Iterator[tuple[DataFrame, int]]:
    """A run's spellings, labels and features with their number, held while the run works on them."""
    train = rows.select(text_col, label).join(feats, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield train, train.count()
    finally:
        train.unpersist()


def _at_once(spark: SparkSession, work: Callable, jobs: Sequence, parallel: int) -> list:
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), jobs))


def run_grid(runs: Sequence[tuple], feats: DataFrame, test: DataFrame, trees: int, depth: int,
             text_col: str = "smiles", label: str = "value", parallel: int = PARALLEL) -> DataFrame:
    """Fit every (run, seed, training rows) and predict ``test``: run, seed, n_train, entity_id, y_true, y_pred, a written table.
    A run with a fourth part, a first-stage model, starts from that model (``second_stage``)."""
    spark = test.sparkSession
    held = test.join(feats, text_col)
    out = scratch_path(spark, "forest-predictions")

    def one(job: tuple) -> None:
        run, seed, rows, *stage1 = job
        with _train_rows(rows, feats, text_col, label) as (train, n_train):
            if stage1:
                pred = second_stage(packed(train, n_train), held, stage1[0], trees, depth, seed, label)
            else:
                pred = fit(packed(train, n_train), trees, depth, seed, label).transform(held)
            pred.select(F.lit(run).alias("run"), F.lit(seed).alias("seed"), F.lit(n_train).cast("bigint").alias("n_train"), "entity_id",
                        F.col(label).alias("y_true"), F.col("prediction").alias("y_pred")).write.parquet(f"{out}/{run}-{seed}")

    _at_once(spark, one, runs, parallel)
    return spark.read.parquet(*[f"{out}/{run}-{seed}" for run, seed, *_ in runs])


def first_stage(sets: dict[str, DataFrame], seeds: Sequence[int], feats: DataFrame, trees: int, depth: int, text_col: str = "smiles",
                label: str = "value", parallel: int = PARALLEL) -> dict[tuple[str, int], RandomForestRegressionModel | None]:
    """A forest per set and seed, from which the second stages of that seed start (none of a set without rows)."""
    def one(job: tuple[str, int]) -> RandomForestRegressionModel | None:
        with _train_rows(sets[job[0]], feats, text_col, label) as (train, n_train):
            return fit(packed(train, n_train), trees, depth, job[1], label) if n_train else None

    jobs = [(name, seed) for seed in seeds for name in sets]
    return dict(zip(jobs, _at_once(feats.sparkSession, one, jobs, parallel), strict=True))


def second_stage(train: DataFrame, held: DataFrame, stage1: RandomForestRegressionModel, trees: int, depth: int, seed: int,
                 label: str = "value") -> DataFrame:
    """``held`` with the prediction of a first-stage model after its second stage on ``train``. A forest has no weights to go on from:
    the second stage fits what the first one leaves of the labels, so that it starts at the first one's predictions."""
    left = stage1.transform(train).select("features", (F.col(label) - F.col("prediction")).alias(label))
    model = fit(left, trees, depth, seed, label)
    both = model.transform(stage1.transform(held).withColumnRenamed("prediction", "_first"))
    return both.withColumn("prediction", F.col("_first") + F.col("prediction")).drop("_first")


def learning_curve(real: DataFrame, synthetic: dict[str, DataFrame], feats: DataFrame, test: DataFrame, sizes: Sequence[int],
                   seeds: Sequence[int], trees: int, depth: int, id_col: str = "entity_id") -> DataFrame:
    """train_set, subset, mean and SD over seeds of the test MAE: for every nested subset of the real rows a forest on these alone
    (``real``) and one in two stages from each synthetic set that has rows (``twostage_<set>``), whose first stage all subsets of a seed
    share."""
    starts = first_stage(synthetic, seeds, feats, trees, depth)
    runs = []
    for seed in seeds:
        order = nested_subsets(real, id_col, seed, sizes)
        for k in [*(f"n{n}" for n in sizes), "full"]:
            rows = real.join(order.filter(F.col("subset") == k).select(id_col), id_col)
            runs.append((f"real_{k}", seed, rows))
            runs += [(f"twostage_{name}_{k}", seed, rows, starts[name, seed]) for name in synthetic if starts[name, seed]]
    m = run_summary(grid_metrics(run_grid(runs, feats, test, trees, depth)), cols=["mae"])
    return m.select(F.regexp_extract("run", "(.*)_", 1).alias("train_set"), F.substring_index("run", "_", -1).alias("subset"),
                    "mae_mean", "mae_sd", "n_seeds")


def pseudo_labeled(rows: DataFrame, teacher: RandomForestRegressionModel, feats: DataFrame, text_col: str = "smiles", label: str = "value") -> DataFrame:
    """Rows with the teacher's predictions in place of their labels."""
    p = teacher.transform(rows.drop(label).join(feats, text_col))
    return p.withColumnRenamed("prediction", label).drop("features")


def grid_metrics(predictions: DataFrame) -> DataFrame:
    """n_train, n_test, MAE, RMSE, R2, mean signed error and Spearman of every run and seed."""
    return regression_metrics(predictions, ["run", "seed", "n_train"]).withColumnRenamed("n", "n_test")


def experiment_grid(set_sizes: DataFrame, sizes: Sequence[int | None], seeds: Sequence[int],
                    set_col: str = "train_set", n_col: str = "set_rows") -> DataFrame:
    """Set x size x seed table with the training rows of each run (sizes None = full). The small dimension lists
    are exploded per set row (no cross join)."""
    size_arr = F.array(*[F.lit(s).cast("bigint") for s in sizes])
    g = set_sizes.withColumn("size", F.explode(size_arr)).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return g.select(set_col, F.coalesce(F.col("size").cast("string"), F.lit("full")).alias("size"), "seed",
                    F.least(F.coalesce("size", F.col(n_col)), F.col(n_col)).alias("n_train_rows"))
