"""Hard negatives by a vertical scan of columnar blocks (BOND).

Vectors hold whole numbers; a row's score is its exact inner product with the anchor. Rows lie in blocks of bounded bytes, a
column a dimension. For each anchor the columns are read in descending order of the anchor's magnitudes, STEP at a time. After each
step a candidate's score lies between its partial sum plus the least and plus the most that the columns still unread can add
(from their minima and maxima in the block); candidates that can no longer count leave the candidate list, and what is left
after the last column has its exact score.

Two scans. The first finds each anchor's positives, its best rows of the same label: a candidate goes once its upper bound is
under the last place reached so far or under that place among the lower bounds. Each positive opens a window of scores;
the second scan finds the best rows of other labels inside the windows: a candidate goes once its bounds miss every window, or stay under the last
place of every window they touch. A task carries its best places from block to block and returns those only; places are merged
by a window over (anchor, window), cut map-side.

Anchors go to the tasks in blocks of ANCHOR_BYTES on average (dealt by hash, so the bound of a broadcast doesn't grow), and every block is
one pass over all rows, whose results are written before the next pass.

Cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part; vectors of different
lengths have no score with each other; an empty vector scores 0. A row that carries the anchor's id is neither its positive nor its negative; other
repeated rows take a place each. Anchors that repeat id, label and vector are mined once. Ties go to the smaller id.
An anchor without positives or a positive without negatives gives no rows, so does an empty table. Further columns are ignored. Scores must stay
below 2**53 (exact in double arithmetic), else the query fails with a message."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augeval.session import cut_lineage, scratch_path, spread

BLOCK_BYTES = 8 << 20     # bytes of a block's columns
ANCHOR_BYTES = 16 << 20   # bytes of the vectors of one pass's anchors, on average
STEP = 8                  # columns read between two looks at the bounds
EXACT = float(1 << 53)


def whole_vectors(df: DataFrame, scale: int = 256, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vec): rows that take part, their components as floor(scale * x)."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~bad) \
        .select("vec_id", F.col(label).alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vec"))


class Anchors:
    """Anchors of one pass: ids, label codes, vectors, column orders; windows of the second scan."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("vec_id").to_numpy().astype(np.int64)
        labels = table.column("label").to_pylist()
        self.code = {v: i for i, v in enumerate(dict.fromkeys(labels))}
        self.label = np.array([self.code[v] for v in labels], np.int64)
        self.vec = [np.array(v, np.float64) for v in table.column("vec").to_pylist()]
        self.order = [np.argsort(-np.abs(v), kind="stable") for v in self.vec]
        self.windows: list = []

    def set_windows(self, key: np.ndarray, score: np.ndarray, low: int, high: int, by: int) -> None:
        """The distinct scores of each anchor's positives with the least and the greatest score of their negatives."""
        self.windows = [[] for _ in self.ids]
        for k, p in sorted(set(zip(key.tolist(), score.tolist(), strict=True))):
            lo, hi = -(-low * p // by), high * p // by
            if lo <= hi:
                self.windows[k].append((p, lo, hi))


def _matrices(batches, code: dict):
    """(ids, label codes, columns) of blocks of one vector length and bounded bytes, rows sorted by label."""
    held: dict[int, list] = {}

    def block(length):
        ids, codes, cols = (np.concatenate(x, axis=-1) for x in zip(*held.pop(length), strict=True))
        order = np.argsort(codes, kind="stable")
        return ids[order], codes[order], np.ascontiguousarray(cols[:, order])

    for b in batches:
        vec, offs = b.column("vec"), b.column("vec").offsets.to_numpy()
        values = vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
        ids = b.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
        own = b.column("label").dictionary_encode()
        to = np.array([code.get(v, -1) for v in own.dictionary.to_pylist()], np.int64)
        codes, sizes = to[own.indices.to_numpy()], np.diff(offs)
        for length in np.unique(sizes).tolist():
            rows, step = np.flatnonzero(sizes == length), max(1, BLOCK_BYTES // (8 * max(1, length)))
            for at in range(0, len(rows), step):
                r = rows[at:at + step]
                held.setdefault(length, []).append((ids[r], codes[r], values[offs[r][:, None] + np.arange(length)].T))
                if sum(len(p[0]) for p in held[length]) >= step:
                    yield block(length)
    for length in list(held):
        yield block(length)


def vertical_scan(cols: np.ndarray, cand: np.ndarray, q: np.ndarray, order: np.ndarray, least: np.ndarray, most: np.ndarray, alive) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that ``alive(lower bounds, upper bounds)`` keeps to the end, with exact scores. ``least`` and
    ``most``: the columns' minima and maxima."""
    low, high = np.minimum(q * least, q * most)[order], np.maximum(q * least, q * most)[order]
    if len(q) and np.abs(q * np.maximum(np.abs(least), np.abs(most))).sum() >= EXACT:
        raise ValueError("scores of 2**53 or more are not exact")
    rest_low, rest_high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (low, high))
    part = np.zeros(len(cand))
    for at in range(0, len(q), STEP):
        dims = order[at:at + STEP]
        part += q[dims] @ cols[dims[:, None], cand]
        to = at + len(dims)
        if to < len(q):
            keep = alive(part + rest_low[to], part + rest_high[to])
            if not keep.all():
                cand, part = cand[keep], part[keep]
            if not len(cand):
                break
    return cand, part


def _best(found: list, score: np.ndarray, ids: np.ndarray, k: int) -> list:
    """The first k of the (-score, id) pairs found so far and those given."""
    if len(score) > k:
        keep = score >= np.partition(score, -k)[-k]
        score, ids = score[keep], ids[keep]
    return sorted(found + [(-int(s), int(i)) for s, i in zip(score, ids, strict=True)])[:k]


def _positives(shared, k: int):
    def run(batches):
        a: Anchors = shared.value
        best: list[list] = [[] for _ in a.ids]
        for ids, codes, cols in _matrices(batches, a.code):
            at, ranges = np.searchsorted(codes, np.arange(len(a.code) + 1)), {}
            for i, q in enumerate(a.vec):
                c = a.label[i]
                lo, hi = at[c], at[c + 1]
                if lo == hi or len(q) != len(cols):
                    continue
                if c not in ranges:
                    ranges[c] = (cols[:, lo:hi].min(1), cols[:, lo:hi].max(1))

                def alive(low, high, i=i):
                    t = -best[i][-1][0] if len(best[i]) == k else -np.inf
                    if len(low) > k:
                        t = max(t, np.partition(low, -k)[-k])
                    return high >= t
                cand = lo + np.flatnonzero(ids[lo:hi] != a.ids[i])
                cand, score = vertical_scan(cols, cand, q, a.order[i], *ranges[c], alive)
                if len(cand):
                    best[i] = _best(best[i], score, ids[cand], k)
        rows = [(i, -s, x) for i, b in enumerate(best) for s, x in b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=["anchor", "score", "vec_id"])
    return run


def _negatives(shared, k: int):
    def run(batches):
        a: Anchors = shared.value
        best = {(i, p): [] for i, ws in enumerate(a.windows) for p, _, _ in ws}
        for ids, codes, cols in _matrices(batches, a.code):
            bounds = (cols.min(1), cols.max(1)) if len(ids) else None
            for i, q in enumerate(a.vec):
                if not a.windows[i] or len(q) != len(cols):
                    continue

                def alive(low, high, i=i):
                    keep = np.zeros(len(low), bool)
                    for p, least, most in a.windows[i]:
                        b = best[i, p]
                        t = max(least, -b[-1][0]) if len(b) == k else least
                        sure = low[high <= most]  # k of these lie in the window, or all under it
                        if len(sure) > k:
                            t = max(t, np.partition(sure, -k)[-k])
                        keep |= (high >= t) & (low <= most)
                    return keep
                cand = np.flatnonzero((codes != a.label[i]) & (ids != a.ids[i]))
                cand, score = vertical_scan(cols, cand, q, a.order[i], *bounds, alive)
                for p, least, most in a.windows[i] if len(cand) else []:
                    inside = (score >= least) & (score <= most)
                    if inside.any():
                        best[i, p] = _best(best[i, p], score[inside], ids[cand[inside]], k)
        rows = [(i, p, -s, x) for (i, p), b in best.items() for s, x in b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)],
                                             names=["anchor", "positive_score", "score", "vec_id"])
    return run


def _first(df: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, by: int = 100) -> DataFrame:
    """(vec_id, label, vec) rows of whole-number vectors and the condition that makes a row an anchor -> anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score: for each anchor and each of its first ``positives`` rows of the same
    label the first ``negatives`` rows of other labels with low * positive_score <= by * negative_score <= high * positive_score."""
    spark = rows.sparkSession
    rows = cut_lineage(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "vec"), "bond-rows")
    anchors = rows.where(is_anchor).distinct()
    wide = anchors.agg(F.sum(F.size("vec") + 8)).first()[0] or 0
    passes = max(1, -(-8 * wide // ANCHOR_BYTES))
    pos_path, neg_path = scratch_path(spark, "bond-positives"), scratch_path(spark, "bond-negatives")
    table = spread(rows)
    for n in range(passes):
        some = anchors if passes == 1 else anchors.where(F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(passes)) == n)
        block = Anchors(some.toArrow())  # bounded by ANCHOR_BYTES on average
        names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(block.ids))), "anchor_id": pa.array(block.ids)})) \
            if len(block.ids) else spark.createDataFrame([], "anchor long, anchor_id long")
        shared = spark.sparkContext.broadcast(block)
        found = table.mapInArrow(_positives(shared, positives), "anchor long, score long, vec_id long")
        found = _first(found, positives, "anchor").drop("rank").join(names, "anchor").withColumn("pass", F.lit(n))
        found.write.mode("append").parquet(pos_path)
        own = spark.read.parquet(pos_path).where(F.col("pass") == n).select("anchor", "score").toArrow()  # ``positives`` rows an anchor
        block.set_windows(own.column("anchor").to_numpy(), own.column("score").to_numpy(), low, high, by)
        shared.unpersist()
        shared = spark.sparkContext.broadcast(block)
        found = table.mapInArrow(_negatives(shared, negatives), "anchor long, positive_score long, score long, vec_id long")
        _first(found, negatives, "anchor", "positive_score").withColumn("pass", F.lit(n)).write.mode("append").parquet(neg_path)
        shared.unpersist()
    p = spark.read.parquet(pos_path).select("pass", "anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    n = spark.read.parquet(neg_path).select("pass", "anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return p.join(n, ["pass", "anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
