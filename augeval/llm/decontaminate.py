"""Benchmark passages in documents by a prefix-filtered join of shingles. DataFrame functions only.

A window is WINDOW consecutive words of an item, or a whole shorter item. It occurs in a document if all its shingles of SHINGLE words do (shorter
windows are their own shingle), so one shingle is a sufficient prefix: a first scan counts every shingle of the benchmark in all
documents, and a window keeps its rarest shingle only (a window with a shingle that no document has is dropped). A second scan joins the
documents' shingles with these prefixes. Shingle and prefix fix the place of the window; it has to lie inside the document
(positional and length bound), then the words there are compared with the window's. A document's words are split in the row that
holds them, so texts are never shuffled: only a document's header (id, words) and its verified windows are.

The prefixes are broadcast in passes of PASS_BYTES, the shingles to count in passes of PASS_SHINGLES, both by counting first: a larger
benchmark takes more scans, not larger broadcasts.

Cases: a null text has no words; a null item id counts as the text ''; items that repeat an id count once; documents that repeat an id
are judged row by row; items without words have no window; an empty benchmark leaves every document clean; no documents give no rows. Further columns are
ignored."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augeval.session import cut_lineage

WINDOW = 10
SHINGLE = 3
PASS_BYTES = 32 << 20
PASS_SHINGLES = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    """'' and then the words of a text (A-Z in lower case, maximal runs of a-z, 0-9 and everything beyond ASCII); a separator
    at its end gives another ''."""
    text = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    plain = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _SPLIT)


def words(text: Column) -> Column:
    """Words of a text."""
    return F.array_remove(_split(text), "")


def _tokens(docs: DataFrame, widths: list[int], *carried: str) -> DataFrame:
    """Each word's place p (from 1; 0 is a document's header) and the hashes of the shingles that begin there, a row a width.

    The hash is taken after the words are exploded, so it is compiled code that looks at the row's array; shingles that reach over the end do no
    harm. The array is never empty: the outer form only keeps Catalyst from adding a filter that would split the text again."""
    t = docs.select("ws", *carried, F.posexplode_outer("ws").alias("p", "w"))
    hashes = [F.expr(f"xxhash64(w{''.join(f', get(ws, p + {k})' for k in range(1, n))})") for n in widths or [1]]
    if len(hashes) == 1:
        return t.withColumn("token", hashes[0])
    return t.withColumn("tokens", F.array(*[h if i == 0 else F.when(F.col("p") > 0, h) for i, h in enumerate(hashes)])) \
        .select(*t.columns, F.explode_outer("tokens").alias("token")).where((F.col("p") > 0) | F.col("token").isNotNull())


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(item_id, text) -> the distinct windows as (win, words) and the items of each as (win, item), both written tables."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws")).where("size(ws) > 0")
    w = b.select("item", F.expr(f"explode(transform(sequence(0, greatest(size(ws) - {window}, 0)), i -> slice(ws, i + 1, {window})))").alias("words"))
    w = cut_lineage(w.distinct(), "windows")
    ids = cut_lineage(w.select("words").distinct().select(F.monotonically_increasing_id().alias("win"), "words"), "window-ids")
    return ids, cut_lineage(w.join(ids, "words").select("win", "item"), "window-items")


def prefixes(docs: DataFrame, wins: DataFrame, widths: list[int], shingle: int = SHINGLE) -> DataFrame:
    """The rarest shingle of each window over all documents: win, words, k (words), h (the shingle's hash), ahead (words before it)."""
    k = F.size("words")
    s = wins.withColumn("k", k).withColumn("width", F.least(k, F.lit(shingle)))
    of = lambda n: f"transform(sequence(0, k - {n}), i -> named_struct('h', xxhash64({', '.join(f'words[i + {j}]' for j in range(n))}), 'ahead', i))"
    s = s.select("win", "k", F.explode(F.expr("case " + " ".join(f"when width = {n} then {of(n)}" for n in widths or [1]) + " end")).alias("s")) \
        .select("win", "k", "s.h", "s.ahead")
    s = cut_lineage(s, "window-shingles")
    wanted = s.select("h").distinct()
    passes = max(1, -(-wanted.count() // PASS_SHINGLES))
    seen = _tokens(docs, widths).where("p > 0").select(F.col("token").alias("h"))
    counts = [seen.join(F.broadcast(wanted.where(F.pmod("h", F.lit(passes)) == n)), "h").groupBy("h").agg(F.count("*").alias("seen"))
              for n in range(passes)]
    counts = cut_lineage(reduce(DataFrame.union, counts), "shingle-counts")
    s = s.join(counts, "h", "left")
    rarest = s.groupBy("win", "k").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "ahead")).alias("s")).where("s.seen > 0")
    return cut_lineage(rarest.select("win", "k", "s.h", "s.ahead").join(wins, "win"), "prefixes")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """One scan's table: a header row a document (doc_id, n_words; win null) and a row for each window that occurs in it (win, from, to), both
    with the key (k1, k2) of the document's id and text; and the items of the windows."""
    d = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit("key"), "doc_id").alias("k2"), "doc_id",
                    _split(F.col("text")).alias("ws"))
    wins, items = windows(benchmark, window)
    widths = sorted(r[0] for r in wins.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect())  # ``shingle`` values at most
    pre = prefixes(d.select("ws"), wins, widths, shingle)
    size = pre.agg(F.sum(F.expr("aggregate(words, 64L, (a, w) -> a + octet_length(w) + 16)"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    t = _tokens(d, widths, "k1", "k2", "doc_id").withColumn("n", F.expr("size(ws) - 1 - if(element_at(ws, -1) = '', 1, 0)"))
    out = []
    for m in range(passes):
        some = F.broadcast(pre.where(F.pmod(F.xxhash64("win"), F.lit(passes)) == m))
        head, at = F.col("p") == 0, F.col("p") - 1 - F.col("ahead")
        held = ~head & (F.col("token") == F.col("h")) & (at >= 0) & (at + F.col("k") <= F.col("n")) \
            & (F.slice("ws", F.greatest(at, F.lit(0)) + 2, F.col("k")) == F.col("words"))
        rows = t.join(some, held, "left" if m == 0 else "inner").where(head | F.col("win").isNotNull())
        out.append(rows.select("k1", "k2", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("n").cast("long")).alias("n_words"),
                               "win", at.alias("from"), (at + F.col("k")).alias("to")))
    return cut_lineage(reduce(DataFrame.union, out), "occurrences"), items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> per document doc_id, n_words, n_hit (words inside an occurring window), spans (their places,
    as from and to in words, one a window) and items (the ids of items with occurring windows as texts, sorted)."""
    found, items = occurrences(docs, benchmark, window, shingle)
    # A document's windows are bounded by its words: one window of each length starts at a word.
    hits = found.where("win is not null").groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"), F.collect_set("win").alias("wins"))
    hits = hits.withColumn("n_hit", F.expr(
        "aggregate(spans, named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct('upto', greatest(a.upto, s.to), "
        "'n', a.n + greatest(0, s.to - greatest(a.upto, s.from)))).n"))
    named = hits.select("k1", "k2", F.explode("wins").alias("win")).join(items, "win").groupBy("k1", "k2") \
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    head = found.where("win is null").select("k1", "k2", "doc_id", "n_words")
    out = head.join(hits.drop("wins"), ["k1", "k2"], "left").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("spans", F.expr("cast(array() as array<struct<from:int,to:int>>)")).alias("spans"),
                      F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
