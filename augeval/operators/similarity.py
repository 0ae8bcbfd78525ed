"""Hashed token fingerprints and nearest-reference Tanimoto similarity.

Tanimoto(q, r) = c / (a + b - c) with c the shared on-bits of sets of sizes a and b. Sets that reach a similarity m share one
of the rarest a - ceil(m * a) + 1 bits of each side and differ in size by a factor of m at most; so a search from m on joins those
prefixes only. The largest similarity of every item is found by falling m: equal sets are settled first, then what reaches m, the rest
goes on with longer prefixes, and what is left at the end meets every set that shares a bit. Where bands or bits would meet too many
pairs (dense fingerprints), blocks of sets meet blocks of sets as matrices: a task holds two blocks, and no pair is a row."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augeval.session import cut_lineage, spread

# Fixed value: the token pattern splits on every run of characters that are neither letters nor digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def add_tokens(df: DataFrame, text_col: str, out: str = "_tokens") -> DataFrame:
    """Lower-case word tokens of the whole text (empty pieces removed)."""
    return df.withColumn(out, F.filter(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT), lambda t: t != ""))


def add_ngrams(df: DataFrame, tokens_col: str, max_n: int, out: str = "_grams") -> DataFrame:
    """All token n-grams for n = 1..max_n, joined by a space (Spark ML's JVM ``NGram`` transformer per n)."""
    from pyspark.ml.feature import NGram
    cols = [F.col(tokens_col)]
    for k in range(2, max_n + 1):
        df = NGram(n=k, inputCol=tokens_col, outputCol=f"_ng{k}").transform(df)
        cols.append(F.col(f"_ng{k}"))
    return df.withColumn(out, F.concat(*cols)).drop(*[f"_ng{k}" for k in range(2, max_n + 1)])


def _hash_bits(max_n: int, bits: int):
    """Column function: tokens -> distinct sorted bit positions of their n-grams up to ``max_n``, joined by a space: the first 8 hex
    digits of a gram's md5, modulo ``bits``. A text's equal grams are hashed once."""
    def of(tokens: list[str] | None) -> np.ndarray | None:
        if tokens is None:
            return None
        w = [t.encode() for t in tokens]
        grams = set(w)
        for n in range(2, max_n + 1):
            grams.update(map(b" ".join, zip(*[w[i:] for i in range(n)])))
        words = np.frombuffer(b"".join([md5(g).digest() for g in grams]), ">u4")[::4]
        return np.unique((words % bits).astype(np.int32))

    @F.arrow_udf("array<int>")
    def hashed(tokens: pa.Array) -> pa.Array:
        return pa.array([of(t) for t in tokens.to_pylist()], pa.list_(pa.int32()))
    return hashed


def fingerprint(df: DataFrame, text_col: str, bits: int = 2048, radius: int = 2, out: str = "bits") -> DataFrame:
    """Fixed-width binary fingerprint (as the list of on-bits) from hashed token n-grams up to radius + 1."""
    d = add_tokens(df, text_col)
    return d.withColumn(out, _hash_bits(radius + 1, bits)("_tokens")).drop("_tokens")


BANDS = (0.8, 0.6, 0.4, 0.2)
WORTH = 16     # a band, or the join on all bits, is taken if it joins at most a WORTH-th of the rows that it would save: pairs of
               # blocks for the join; joined rows or pairs of blocks, whichever is cheaper, for a band
BLOCK = 2048   # sets of a block at most
CELLS = 1 << 25   # of a block (sets x bits that occur in it) at most, if it holds more than one set
STRIP = 2048   # columns of a product of two blocks at a time


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k, _bits) rows -> blocks: the keys, the bits that occur, and for each set a bitmap over those."""
    def packed(keys: pa.Array, values: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        n, base = len(keys), ends[0]
        cols, at = np.unique(values[base:ends[-1]], return_inverse=True)
        if n > 1 and n * len(cols) > CELLS:
            half = n // 2
            yield from packed(keys[:half], values, ends[:half + 1])
            yield from packed(keys[half:], values, ends[half:])
            return
        on = np.zeros((n, len(cols)), dtype=np.uint8)
        on[np.repeat(np.arange(n), np.diff(ends)), at] = 1
        yield keys.to_pylist(), cols.astype("<i4").tobytes(), np.packbits(on, axis=1).tobytes()

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            bits = part.column("_bits")
            ends = np.concatenate(([0], np.cumsum(bits.value_lengths().fill_null(0).to_numpy())))
            for keys, cols, on in packed(part.column("_k"), bits.flatten().to_numpy(zero_copy_only=False), ends):
                yield pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(part.column("_k").type)), pa.array([cols], pa.binary()), pa.array([on], pa.binary())],
                                                 ["keys", "cols", "sets"])


def _blocks(df: DataFrame, key: str, bits_col: str, prefix: str) -> DataFrame:
    """Blocks of sets, a written table: <prefix>keys, <prefix>cols, <prefix>sets."""
    d = df.select(F.col(key).alias("_k"), F.col(bits_col).cast("array<int>").alias("_bits"))
    kind = d.schema["_k"].dataType.simpleString()
    b = d.mapInArrow(_pack, f"keys array<{kind}>, cols binary, sets binary")
    return cut_lineage(b.select(*[F.col(c).alias(prefix + c) for c in b.columns]), "similar-blocks")


def _unpacked(n: int, cols: bytes, sets: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(cols, "<i4")
    on = np.frombuffer(sets, np.uint8).reshape(n, -1) if len(at) else np.zeros((n, 0), np.uint8)
    return at, np.unpackbits(on, axis=1, count=len(at)) if len(at) else on


def _block_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks -> (_k, _s): the largest similarity of each set of the first block to a set of the second."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, qc, qs, n, rc, rs = (batch.column(c)[i] for c in ("a_keys", "a_cols", "a_sets", "n", "b_cols", "b_sets"))
            qat, q = _unpacked(len(keys), qc.as_py(), qs.as_py())
            rat, r = _unpacked(n.as_py(), rc.as_py(), rs.as_py())
            _, qi, ri = np.intersect1d(qat, rat, assume_unique=True, return_indices=True)
            sizes = q.sum(axis=1, dtype=np.float64)[:, None] + r.sum(axis=1, dtype=np.float64)[None, :]
            both = np.zeros((len(q), len(r)), dtype=np.float32)   # counts under 2**24 are exact
            for j in range(0, len(qi), STRIP):
                both += q[:, qi[j:j + STRIP]].astype(np.float32) @ r[:, ri[j:j + STRIP]].astype(np.float32).T
            sizes -= both
            best = np.divide(both, sizes, out=np.zeros_like(sizes), where=sizes > 0).max(axis=1, initial=0.0)
            yield pa.RecordBatch.from_arrays([keys.values, pa.array(best)], ["_k", "_s"])


def _best_of_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(_k, _s) of every pair of a block of ``a`` with one of ``b``: the blocks of ``a`` are dealt to groups, those of ``b`` go to each."""
    kind = a.schema["a_keys"].dataType.elementType.simpleString()
    groups = 2 * a.sparkSession.sparkContext.defaultParallelism
    dealt = a.withColumn("_g", F.pmod(F.xxhash64("a_keys"), F.lit(groups))).repartition(groups, "_g")   # few bytes, many pairs
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))
    pairs = dealt.join(b.select(each.alias("_g"), F.size("b_keys").alias("n"), "b_cols", "b_sets"), "_g")
    return pairs.mapInArrow(_block_best, f"_k {kind}, _s double")


def _sets(df: DataFrame, bits_col: str, side: str) -> DataFrame:
    """Distinct fingerprints, not empty."""
    return df.select(F.array_sort(bits_col).alias(side)).where(F.size(side) > 0).distinct()


def _rare_first(df: DataFrame, side: str, freq: DataFrame) -> DataFrame:
    """Add ``_rare``, the bits from rare to common by their count among the references."""
    d = df.withColumn("_f", freq.select("_f").scalar())
    keyed = F.array_sort(F.transform(side, lambda x: F.struct(F.coalesce(F.try_element_at("_f", x), F.lit(0)).alias("n"), x.alias("bit"))))
    return d.select(*df.columns, F.transform(keyed, lambda x: x["bit"]).alias("_rare"))


def _prefix_length(side: str, minimum: float) -> Column:
    n = F.size(side)
    return (n - F.ceil(n * F.lit(minimum)) + 1).cast("int")


def _prefix(df: DataFrame, side: str, minimum: float) -> DataFrame:
    """(side, bit): the bits of which a set of similarity ``minimum`` or more must share one."""
    return df.select(side, F.explode(F.slice("_rare", F.lit(1), _prefix_length(side, minimum))).alias("bit"))


def _frequencies(ref: DataFrame, bits_col: str) -> DataFrame:
    """One map of bit -> references with it (a table bounded by the fingerprint's width)."""
    freq = ref.select(F.explode(bits_col).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    return freq.agg(F.map_from_entries(F.collect_list(F.struct("bit", "n"))).alias("_f"))


def met_pairs(q: DataFrame, r: DataFrame, minimum: float) -> DataFrame:
    """(_q, _r) of the sets that a search from ``minimum`` on has to compare."""
    a, b = F.size("_q"), F.size("_r")
    return _prefix(q, "_q", minimum).join(_prefix(r, "_r", minimum), "bit") \
        .where((b >= a * minimum) & (a >= b * minimum)).select("_q", "_r").distinct()


def _best(met: DataFrame, minimum: float, out: str) -> DataFrame:
    c = F.size(F.array_intersect("_q", "_r"))
    s = met.select("_q", F.try_divide(c, F.size("_q") + F.size("_r") - c).alias("_s"))
    return s.where(F.col("_s") >= minimum).groupBy("_q").agg(F.max("_s").alias(out))


def _joined_rows(q: DataFrame, r: DataFrame, minima: Sequence[float]) -> list[int]:
    """Rows that the join of the prefixes makes for each minimum, from the counts of each bit, in one job."""
    def counts(df, side, name):
        d = df.select(*[_prefix_length(side, m).alias(f"_l{i}") for i, m in enumerate(minima)], F.posexplode("_rare").alias("_p", "bit"))
        return d.groupBy("bit").agg(*[F.count_if(F.col("_p") < F.col(f"_l{i}")).alias(f"{name}{i}") for i in range(len(minima))])
    j = counts(q, "_q", "a").join(counts(r, "_r", "b"), "bit")
    return [x or 0 for x in j.agg(*[F.sum(F.col(f"a{i}") * F.col(f"b{i}")) for i in range(len(minima))]).first()]


def max_tanimoto(query: DataFrame, ref: DataFrame, id_col: str = "vec_id", bits_col: str = "bits",
                 out: str = "max_tanimoto", bands: Sequence[float] = BANDS) -> DataFrame:
    """For each query item the largest Tanimoto similarity to any reference item (0 when none shares a bit).

    Distinct fingerprints are compared once; those that are among the references are settled at once. A band of ``bands`` settles the
    sets that reach it; one that would not save work (dense fingerprints) is passed over. Sets that no band settles meet all references
    that share a bit, by join on the bit where that is sparse, else block by block."""
    freq = _frequencies(ref, bits_col)
    # Numbered in a written table, so that a number stands for its set.
    r = cut_lineage(_rare_first(_sets(ref, bits_col, "_r"), "_r", freq).withColumn("_i", F.monotonically_increasing_id()), "similar-references")
    q = _rare_first(_sets(query, bits_col, "_q"), "_q", freq).join(r.select(F.col("_r").alias("_q"), F.lit(1.0).alias(out)), "_q", "left")
    q = cut_lineage(q.withColumn("_k", F.monotonically_increasing_id()), "similar-queries")
    settled, left = [q.where(F.col(out).isNotNull()).select("_q", out)], sorted(bands, reverse=True)
    q, refs = q.where(F.col(out).isNull()).drop(out), r.count()
    while True:
        *rows, every = _joined_rows(q, r, [*left, 0.0])
        pairs = q.count() * refs
        sparse = WORTH * every <= pairs
        worth = [m for m, n in zip(left, rows, strict=True) if WORTH * n <= (every if sparse else pairs)]
        if not worth or not every:
            break
        settled.append(cut_lineage(_best(met_pairs(q, r, worth[0]), worth[0], out), "similar-settled"))
        q = cut_lineage(q.join(settled[-1].select("_q"), "_q", "left_anti"), "similar-queries")
        left = [m for m in left if m < worth[0]]
    if sparse:
        a = spread(q).select("_k", F.size("_q").alias("a"), F.explode("_q").alias("bit"))   # few bytes, many pairs
        b = r.select("_i", F.size("_r").alias("b"), F.explode("_r").alias("bit"))
        rest = a.join(b, "bit").groupBy("_k", "_i").agg(F.count(F.lit(1)).alias("c"), F.first("a").alias("a"), F.first("b").alias("b")) \
            .select("_k", (F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).alias("_s"))
    else:
        rest = _best_of_blocks(_blocks(spread(q), "_k", "_q", "a_"), _blocks(r, "_i", "_r", "b_"))
    best = q.join(rest.groupBy("_k").agg(F.max("_s").alias(out)), "_k").select("_q", out)
    for s in settled:
        best = best.union(s.select("_q", out))
    base = query.select(id_col, F.array_sort(bits_col).alias("_q"))
    return base.join(best, "_q", "left").select(id_col, F.coalesce(out, F.lit(0.0)).alias(out))


def nearest_at_least(query: DataFrame, ref: DataFrame, minimum: float, id_col: str = "doc_id", bits_col: str = "bits",
                     out: str = "max_tanimoto") -> DataFrame:
    """Largest Tanimoto similarity of each query item to any reference item, exact where it is ``minimum`` or more, else 0.

    Blocks of items meet blocks of references; an item's fingerprint is packed where it is made and never shuffled."""
    items = query.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("_k"), bits_col)
    a, b = _blocks(items, "_k", bits_col, "a_"), _blocks(ref.select(F.lit(0).alias("_i"), bits_col), "_i", bits_col, "b_")
    s = a.select(F.explode("a_keys").alias("_k"), F.lit(0.0).alias("_s")).union(_best_of_blocks(a, b).where(F.col("_s") >= minimum))
    best = s.groupBy(F.col("_k.row").alias("row")).agg(F.first("_k.id").alias(id_col), F.max("_s").alias(out))
    return best.select(id_col, out)
