"""Bootstrap intervals as Spark jobs: resampling with replacement by a tree of binomial splits, and a one-pass Poisson form.

Resampling deals n draws to n positions. The draws of a resample are split down a tree over ranges of positions: of a node's
draws, a binomial share goes left, with the exact ratio of the two sizes. At a leaf (LEAF positions) the draws that arrive are dealt
to its positions inside the row that holds the leaf's values. So a resample is (leaves) rows, never n, no draw is shuffled and no draw is joined to a position.
Groups that share their draws (paired) share a leaf's weights, which are hashed once and multiplied with the values of each group.
All randomness is md5 text and all arithmetic is in whole numbers, so any engine reproduces the weights."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.functions.keys import seeded_hash
from augeval.operators.sampling import number_within, seeded_order
from augeval.session import cut_lineage, spread


LEAF = 256
_BITS = 60           # of a hash word, and of a split's ratio


def _words(texts: Sequence[bytes]) -> np.ndarray:
    """60 random bits of each text: the first 15 hex digits of its md5."""
    return (np.frombuffer(b"".join([md5(t).digest() for t in texts]), ">u8")[::2] >> 4).astype(np.int64)


def _scaled(u: np.ndarray, n: int) -> np.ndarray:
    """floor(u / 2**60 * n) in whole numbers (n under 2**31)."""
    return ((u >> 28) * n + ((u & ((1 << 28) - 1)) * n >> 28)) >> 32


def _left(seed: int, b: int, lo: int, hi: int, draws: int, left: int, size: int) -> int:
    """How many of a node's draws go left: each compares random bits with the binary digits of left / size, until they differ.

    Digit by digit, the draws still undecided are counted by one random bit each (a popcount of hash words), so half of them are
    decided by a digit and the whole takes about two bits a draw."""
    gone, undecided, rest = 0, draws, left
    for t in range(1, _BITS + 1):
        if not undecided or not rest:
            break
        n = -(-undecided // _BITS)
        words = _words([b"%d|split|%d|%d|%d|%d|%d" % (seed, b, lo, hi, t, w) for w in range(n)])
        words[-1] &= (1 << (undecided - _BITS * (n - 1))) - 1
        ones, rest = int(np.bitwise_count(words).sum()), 2 * rest
        if rest >= size:
            gone, undecided, rest = gone + undecided - ones, ones, rest - size
        else:
            undecided -= ones
    return gone


def leaf_draws(groups: DataFrame, resamples: int, seed: int, by: Sequence[str] = (), leaf: int = LEAF) -> DataFrame:
    """(by, n) -> (by, b, leaf, draws, size): how many of the n draws of each resample fall on each leaf of ``leaf`` positions."""
    by = list(by)

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, b) in enumerate(zip(batch.column("n").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                nodes, found = [(0, -(-n // leaf), n)], []
                while nodes:   # depth first: a path's nodes at a time
                    lo, hi, draws = nodes.pop()
                    if hi - lo > 1:
                        mid = (lo + hi) // 2
                        left = _left(seed, b, lo, hi, draws, min(mid * leaf, n) - lo * leaf, min(hi * leaf, n) - lo * leaf)
                        nodes += [x for x in ((mid, hi, draws - left), (lo, mid, left)) if x[2]]
                    elif draws:
                        found.append((lo, draws, min(leaf, n - lo * leaf)))
                at = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in [*by, "b"]],
                                                  *[pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], [], []))]], [*by, "b", "leaf", "draws", "size"])

    t = groups.select(*by, "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    t = t.repartition(2 * t.sparkSession.sparkContext.defaultParallelism, *by, "b")   # few rows, much work in each
    kinds = ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in [*by, "b"])
    return t.mapInArrow(tree, f"{kinds}, leaf long, draws long, size long")


def _weights(seed: int, leaf: int, size: int, draws: list[dict], width: int) -> np.ndarray:
    """Resamples x places: how often each place of a leaf is drawn."""
    u = _words([b"%d|leaf|%d|%d|%d" % (seed, x["b"], leaf, j) for x in draws for j in range(1, x["draws"] + 1)])
    row = np.repeat(np.arange(len(draws)), [x["draws"] for x in draws])
    return np.bincount(row * width + _scaled(u, size), minlength=len(draws) * width).reshape(len(draws), width).astype(np.float64)


def _resampled(leaves: DataFrame, counts: DataFrame, on: Sequence[str], by: Sequence[str], seed: int, lo: float, hi: float) -> DataFrame:
    """(by, leaf, vals: place in the leaf -> value) and the leaves' draws -> (by, _q): the interval of the resamples' means
    over the values that are there.

    The rows of a leaf lie together, so that its weights (B x LEAF) are made once for all groups that share them."""
    on = [*on, "leaf"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = w = bs = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in on], strict=True))
            for i, key in enumerate(keys):
                if key != last:
                    draws = batch.column("_draws")[i].as_py()
                    vals, last, bs = len(batch.column("vals")[i]), key, [x["b"] for x in draws]
                    w = _weights(seed, key[-1], batch.column("_size")[i].as_py(), draws, vals)
                v = batch.column("vals")[i].values
                there = v.is_valid().to_numpy(zero_copy_only=False)
                v = v.fill_null(0.0).to_numpy(zero_copy_only=False)
                s = w @ v if np.isfinite(v).all() else np.where(w > 0, w * v, 0.0).sum(axis=1)   # a value that is not drawn does not count
                at = pa.array(np.full(len(bs), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in by], pa.array(bs, pa.int32()), pa.array((w @ there).astype(np.int64)), pa.array(s)],
                                                 [*by, "b", "_n", "_s"])

    draws = counts.groupBy(*on).agg(F.collect_list(F.struct("b", "draws")).alias("_draws"), F.first("size").alias("_size"))   # B a leaf
    t = leaves.withColumn("vals", F.col("vals").cast("array<double>")).join(draws, on)
    t = t.repartition(2 * t.sparkSession.sparkContext.defaultParallelism, *on).sortWithinPartitions(*on)   # few bytes, much work in each
    kinds = "".join(f"`{c}` {t.schema[c].dataType.simpleString()}, " for c in by)
    t = t.mapInArrow(dealt, f"{kinds}b int, _n long, _s double")
    means = t.groupBy(*by, "b").agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", [lo, hi]).alias("_q"))   # B values a group


def _leaves(numbered: DataFrame, by: Sequence[str], value: str, leaf: int = LEAF) -> DataFrame:
    """(by, position, value) -> (by, leaf, vals), null where a position has no row. LEAF values a row."""
    at = F.map_from_entries(F.collect_list(F.struct(F.expr(f"(position - 1) % {leaf}").alias("i"), F.col(value).alias("v"))))
    g = numbered.groupBy(*by, F.expr(f"(position - 1) div {leaf}").alias("leaf")).agg(at.alias("_at"))
    return g.select(*by, "leaf", F.transform(F.sequence(F.lit(0), F.lit(leaf - 1)), lambda i: F.try_element_at("_at", i.cast("bigint"))).alias("vals"))


def bootstrap_ci(df: DataFrame, id_col: str, value_col: str, resamples: int = 1000, seed: int = 42,
                 lo: float = 0.025, hi: float = 0.975, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of the mean over B resamples, per group of ``by`` (positions in an md5 order)."""
    by = list(by)
    d = df.select(*by, id_col, value_col).withColumn("_h", seeded_hash(seed, id_col))
    # read twice (leaves, sizes): written once
    leaves = cut_lineage(_leaves(number_within(d, by, ["_h", id_col], F.substring("_h", 1, 3), "position"), by, value_col), "boot-leaves")
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ci = _resampled(leaves, leaf_draws(n, resamples, seed, by), by, by, seed, lo, hi)
    point = df.groupBy(*by).agg(F.avg(value_col).alias("mean"))
    j = point.join(ci, by) if by else point.withColumn("_q", ci.select("_q").scalar())
    return j.select(*by, "mean", F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"))


def paired_bootstrap(errors: DataFrame, reference: DataFrame, id_col: str, by: Sequence[str], value_col: str,
                     resamples: int = 1000, seed: int = 42, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Per group of ``by`` (such as a student run and its seed) the interval of mean(error - reference error) over the entities of
    both, with the same draws over the reference's entities for every group, and whether it excludes zero.

    ``errors``: by, id, value. ``reference``: id, value, one row an entity."""
    by = list(by)
    numbered = seeded_order(reference.select(id_col, F.col(value_col).alias("_r")), id_col, seed, "position")
    d = cut_lineage(errors.select(*by, id_col, value_col).join(numbered, id_col)
                    .select(*by, "position", (F.col(value_col) - F.col("_r")).alias("d")), "boot-differences")
    n = reference.agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(leaf_draws(n, resamples, seed), "boot-draws")   # shared by all groups
    ci = _resampled(_leaves(d, by, "d"), counts, [], by, seed, lo, hi)
    point = d.groupBy(*by).agg(F.avg("d").alias("mean_diff"))
    out = point.join(ci, by).select(*by, "mean_diff", F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"))
    return out.withColumn("excludes_zero", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


# The cumulative Poisson(1) distribution, P(X <= k) = e^-1 * sum_{j<=k} 1/j!, up to the k from which on the
# rest is below the resolution of a double.
POISSON1_CDF = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(17)]


def _poisson_sums(seed: int, resamples: int, by: Sequence[str], rows: int = 500):
    """Rows (by, _id text, _v) -> the sums of the weights and of the weighted values per group and resample, ``rows`` rows at a time."""
    starts = [b"%d|%d" % (seed, b) for b in range(1, resamples + 1)]
    cdf = np.array(POISSON1_CDF)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            ids = [b"" if x is None else b"|" + x.encode() for x in batch.column("_id").to_pylist()]
            u = _words([s + x for x in ids for s in starts]).astype(np.float64) / float(16 ** 15)
            w = np.searchsorted(cdf, u, side="right").reshape(len(ids), resamples).astype(np.float64)
            there = batch.column("_v").is_valid().to_numpy(zero_copy_only=False)
            v = batch.column("_v").fill_null(0.0).to_numpy(zero_copy_only=False)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * len(ids)):
                groups.setdefault(key, []).append(i)
            for at in groups.values():
                first = pa.array(np.full(resamples, at[0]))
                some = there[at].any()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(first) for c in by], pa.array(np.arange(1, resamples + 1), pa.int32()), pa.array(w[at].sum(axis=0).astype(np.int64)),
                     pa.array(v[at] @ w[at]) if some else pa.nulls(resamples, pa.float64())], [*by, "b", "_w", "_s"])
    return sums


def poisson_bootstrap(df: DataFrame, id_col: str, value_col: str, resamples: int = 1000, seed: int = 42,
                      lo: float = 0.025, hi: float = 0.975, by: Sequence[str] = ()) -> DataFrame:
    """One-pass bootstrap for large n: each (row, b) gets a Poisson(1) weight from md5(seed|b|id), by CDF steps; weighted
    means per b are partial aggregates of many rows (no row a draw, no join, no numbering); percentiles of the B means."""
    by = list(by)
    x = spread(df).select(*by, F.col(id_col).cast("string").alias("_id"), F.col(value_col).cast("double").alias("_v"))
    kinds = "".join(f"`{c}` {x.schema[c].dataType.simpleString()}, " for c in by)
    x = x.mapInArrow(_poisson_sums(seed, resamples, by), f"{kinds}b int, _w long, _s double")
    means = x.groupBy(*by, "b").agg(F.try_divide(F.sum("_s"), F.sum("_w")).alias("m"))
    ci = means.groupBy(*by).agg(F.percentile("m", [lo, hi]).alias("_q"))
    point = df.groupBy(*by).agg(F.avg(value_col).alias("mean"))
    j = point.join(ci, by) if by else point.withColumn("_q", ci.select("_q").scalar())
    return j.select(*by, "mean", F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"))
