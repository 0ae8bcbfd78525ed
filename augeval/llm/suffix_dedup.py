"""Passages that repeat across documents, found with sparse suffixes.

Words are runs of anything but space and 0x09-0x0D, compared byte by byte. A passage is a run of ``min_words`` words or
more that stands word for word in another document.

1. Of the suffixes of a text (word positions), only those at content-selected positions are kept: the minimisers of
   the HEAD-word hashes over every min_words-word window, about one in sixteen. Equal windows keep the same suffix. The
   kept suffixes are sorted by their head and neighbours compared (``meeting``): heads of several documents stay.
2. Matches are extended left and right of the heads that met: the windows around such a suffix are sorted and
   compared in the same way, and windows that met are joined to maximal passages.

A text is one owner however often it is copied: the smallest id stands for its copies, whose whole text is a passage.
Texts, heads and windows are compared by 64-bit hashes.

Cases: null or empty texts and texts of fewer words hold no passage; a null id takes no part (its text is left
alone); rows that repeat an id and its text are one document, with another text the id's rows are documents of their
own, led by the same id; passages that repeat only within one document are not passages here; other columns are
ignored (cut_passages keeps them); an empty table has no passages."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.llm.meeting import SCHEMA, met, pack
from augeval.llm.textops import ngram_hash, set_batches, span_hash, text_chunks, words_of
from augeval.session import cut_lineage

MIN_WORDS = 50
HEAD = 20            # words of a suffix that are compared first
ENTRY_BYTES = 8 << 20


def _slide_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    part, have = h, 1
    while have * 2 <= width:
        part = np.minimum(part[:-have], part[have:])
        have *= 2
    return part if have == width else np.minimum(part[:len(part) - (width - have)], part[width - have:])


def windows_of(buf: np.ndarray, offs: np.ndarray, n: int):
    """Windows of n words inside the texts of a chunk: (word index, text, kept suffix of the window, words, word hashes)."""
    w = words_of(buf, offs)
    if len(w.starts) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), w, None
    wh = span_hash(buf, w.starts, w.ends)
    head = min(HEAD, n)
    kept = _slide_min(ngram_hash(wh, head), n - head + 1)
    doc = w.doc[:len(kept)]
    at = np.flatnonzero(np.arange(len(kept)) + n <= w.first[1:][doc])
    return at, doc[at], kept[at], w, wh


def _suffixes(n: int, buckets: int):
    def run(batches):
        for b in batches:
            key = b.column("th").to_numpy()
            for lo, _, buf, offs in text_chunks(b.column("text")):
                at, doc, kept, _, _ = windows_of(buf, offs, n)
                if not len(at):
                    continue
                new = np.concatenate(([True], (kept[1:] != kept[:-1]) | (doc[1:] != doc[:-1])))
                rows = pack(kept[new], key[lo + doc[new]], buckets)
                if rows is not None:
                    yield rows
    return run


_WINDOW = np.dtype([("h", np.uint64), ("doc", np.int64), ("th", np.int64), ("word", np.int32), ("from", np.int32), ("to", np.int32), ("met", np.uint8)])
_PARTS = "bucket long, doc_id long, th long, rows binary, lead long"


def _extend(n: int, buckets: int):
    """Rows (doc_id, th, rep, copied, sigs, text): a copy gives its whole text as a passage; a first text gives its
    windows around the suffixes that met (all of them if it is copied), packed by bucket. Of the windows that meet
    within the chunk only the smallest document's go to the bucket; the others are repeats already."""
    def run(batches):
        for b in batches:
            ids, hashes, reps = (b.column(c).to_numpy() for c in ("doc_id", "th", "rep"))
            sigs, copied = b.column("sigs").to_pylist(), b.column("copied").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                at, doc, kept, w, wh = windows_of(buf, offs, n)
                char = np.zeros(len(buf) + 1, np.int64)
                np.cumsum((buf & 0xC0) != 0x80, out=char[1:])
                count, base = np.diff(w.first), char[offs[:-1]]
                copy = ids[lo:hi] != reps[lo:hi]
                out: list[tuple] = []
                grams = ngram_hash(wh, n) if len(at) else None
                for t in np.flatnonzero(copy & (count >= n)):
                    a, z = w.starts[w.first[t]], w.ends[w.first[t + 1] - 1]
                    low = grams[w.first[t]:w.first[t + 1] - n + 1].view(np.int64).min()
                    whole = np.array([0, char[a] - base[t], char[z] - base[t], count[t], low], np.int64).tobytes()
                    out.append((None, int(ids[lo + t]), int(hashes[lo + t]), whole, int(reps[lo + t])))
                keep = np.zeros(len(at), bool)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                for t in range(hi - lo):
                    part = slice(first[t], first[t + 1])
                    if not copy[t] and copied[lo + t]:
                        keep[part] = True
                    elif not copy[t] and sigs[lo + t] and first[t] < first[t + 1]:
                        keep[part] = np.isin(kept[part], np.array(sigs[lo + t], np.int64).view(np.uint64))
                at, d = at[keep], doc[keep]
                if len(at):
                    rows = np.zeros(len(at), _WINDOW)
                    rows["h"], rows["doc"], rows["th"], rows["word"] = grams[at], ids[lo + d], hashes[lo + d], at - w.first[d]
                    rows["from"], rows["to"] = char[w.starts[at]] - base[d], char[w.ends[at + n - 1]] - base[d]
                    rows = rows[np.lexsort((rows["doc"], rows["h"]))]
                    lead = _leads(rows)
                    side = lead != rows["doc"]
                    rows["met"] = np.isin(rows["h"], rows["h"][side]) | np.isin(rows["doc"], ids[lo:hi][copied[lo:hi]])
                    out += _by_text(rows[side], lead[side], n)
                    rows = rows[~side]
                    bucket = (rows["h"] % np.uint64(buckets)).astype(np.int64)
                    rows, bucket = rows[(by := np.argsort(bucket, kind="stable"))], bucket[by]
                    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(bucket)) + 1):
                        out.append((int(bucket[part[0]]), None, None, rows[part].tobytes(), None))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)],
                                                     names=["bucket", "doc_id", "th", "rows", "lead"])
    return run


def _by_text(rows: np.ndarray, lead: np.ndarray, n: int) -> list[tuple]:
    """Windows of each text, first occurrences and repeats apart, as (word, from, to, words, hash)."""
    if not len(rows):
        return []
    late = lead != rows["doc"]
    order = np.lexsort((rows["word"], late, rows["th"], rows["doc"]))
    rows, lead, late = rows[order], lead[order], late[order]
    cut = np.flatnonzero((np.diff(rows["doc"]) != 0) | (np.diff(rows["th"]) != 0) | (late[1:] != late[:-1])) + 1
    q = np.stack([rows["word"], rows["from"], rows["to"], np.full(len(rows), n), rows["h"].view(np.int64)], 1).astype(np.int64)
    return [(None, int(rows["doc"][p[0]]), int(rows["th"][p[0]]), q[p].tobytes(), int(lead[p].min()))
            for p in np.split(np.arange(len(rows)), cut)]


def _leads(rows: np.ndarray) -> np.ndarray:
    """Smallest document of each window hash; rows are sorted by (h, doc)."""
    new = np.concatenate(([True], rows["h"][1:] != rows["h"][:-1])) if len(rows) else np.zeros(0, bool)
    return rows["doc"][new][np.cumsum(new) - 1] if len(rows) else np.zeros(0, np.int64)


def _windows_met(n: int):
    """Windows of one bucket that stand in several documents, by text."""
    def run(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), _WINDOW)
        rows = rows[np.lexsort((rows["doc"], rows["h"]))]
        lead = _leads(rows)
        at = np.cumsum(np.concatenate(([True], rows["h"][1:] != rows["h"][:-1]))) - 1
        several = np.zeros(int(at[-1]) + 1, bool)
        several[at[(lead != rows["doc"]) | (rows["met"] > 0)]] = True
        out = _by_text(rows[several[at]], lead[several[at]], n)
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table({k: pa.array(cols[i], pa.binary() if i == 3 else pa.int64())
                         for i, k in ((1, "doc_id"), (2, "th"), (3, "rows"), (4, "lead"))})
    return run


def _join_windows():
    """Windows of one document, first occurrences and repeats apart, joined to maximal passages."""
    def run(batches):
        for b in batches:
            out = []
            for doc, th, first, rows in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "is_first", "parts")], strict=True):
                q = np.frombuffer(b"".join(rows), np.int64).reshape(-1, 5)
                q = q[np.argsort(q[:, 0], kind="stable")]
                reach = np.maximum.accumulate(q[:, 0] + q[:, 3])
                cut = np.append(0, np.flatnonzero(q[1:, 0] >= reach[:-1]) + 1)
                end = np.append(cut[1:], len(q)) - 1
                for i, j in zip(cut, end, strict=True):
                    out.append((doc, th, int(q[i, 1]), int(q[i:j + 1, 2].max()), int(q[i, 0]), int(reach[j] - q[i, 0]), int(q[i:j + 1, 4].min()), first))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:7]], pa.array(cols[7], pa.bool_())], names=_SPAN)
    return run


_SPAN = ["doc_id", "th", "start", "end", "start_word", "n_words", "passage", "is_first"]


def find_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages (doc_id, th = xxhash64 of the text, start, end, start_word, n_words, passage, is_first), maximal for their
    document.

    ``start`` and ``end`` are code points; ``is_first`` marks the stretches that no earlier id holds; ``passage`` is the
    smallest hash of a min_words-word window of the passage, so equal passages have equal values."""
    spark = docs.sparkSession
    set_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("doc_id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    text = cut_lineage(d.groupBy("th").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"),
                                           F.max(F.length("text")).alias("chars")), "suffix-texts")
    size = text.agg(F.sum("chars")).first()[0] or 0
    buckets = int(max(24, size // 100 * 16 // ENTRY_BYTES))
    entries = d.select("th", "text").mapInArrow(_suffixes(min_words, buckets), SCHEMA)
    heads = cut_lineage(met(entries), "suffix-heads")
    heads = heads.select("sig", "key").union(heads.select("sig", F.col("lead").alias("key")))
    held = heads.groupBy(F.col("key").alias("th")).agg(F.collect_set("sig").alias("sigs"))
    wanted = text.join(held, "th", "left").where("sigs is not null or rep <> last") \
        .select("th", "rep", (F.col("rep") != F.col("last")).alias("copied"), "sigs")
    set_batches(spark, 200)
    extended = cut_lineage(d.join(wanted, "th").select("doc_id", "th", "rep", "copied", "sigs", "text").mapInArrow(
        _extend(min_words, buckets), _PARTS), "suffix-windows")
    window = extended.where("bucket is not null").groupBy("bucket").applyInArrow(
        _windows_met(min_words), "doc_id long, th long, rows binary, lead long")
    parts = window.union(extended.where("bucket is null").select("doc_id", "th", "rows", "lead"))
    grouped = parts.groupBy("doc_id", "th", (F.col("doc_id") == F.col("lead")).alias("is_first")).agg(
        F.collect_list("rows").alias("parts"))
    return grouped.mapInArrow(_join_windows(), "doc_id long, th long, start long, end long, start_word long, n_words long, passage long, is_first boolean")


def cut_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every passage that an earlier id holds cut out of its text; rows and other columns stay."""
    names = docs.columns
    spans = cut_lineage(find_passages(docs, min_words).where("not is_first").groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")), "suffix-spans")
    set_batches(docs.sparkSession, 200)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_spans")
    d = docs.join(spans, (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_th")), "left")

    def run(batches):
        for b in batches:
            spans, text = b.column("_spans").to_pylist(), b.column("text")
            if any(spans):
                new = []
                for t, cuts in zip(text.to_pylist(), spans, strict=True):
                    if cuts and t is not None:
                        at, keep = 0, []
                        for c in cuts:
                            keep.append(t[at:c["start"]])
                            at = max(at, c["end"])
                        t = "".join([*keep, t[at:]])
                    new.append(t)
                text = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(c) for c in names], names=names)
    return d.select(*names, "_spans").mapInArrow(run, docs.select(*names).schema)
