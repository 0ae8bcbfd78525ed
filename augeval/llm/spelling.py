"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

The vocabulary holds each word's hash, a polynomial of its code points modulo 2**64, so the hash of an edited word follows from
the hash of the word without spelling it out. A blocked filter a length (one 64-bit word a key, lengths from LONG on share one) is made with bit_or and broadcast:
together at most FILTER_BYTES, whatever the vocabulary; with more words the filters are fuller and more edits pass, nothing is lost.
Of a pair one side generates: the longer word its deletions (one a run of equal letters), of equal lengths the
word with the smaller letter the replacements by greater letters of the vocabulary. So every pair is generated once. Only edits that the filter of
their length lets pass are shuffled, as (word's hash, edit's hash, place, letter). An equi-join with the vocabulary on the edit's
hash and one on the word's leave the pairs, whose texts are then compared: false positives and equal hashes go there.

Words are counted in a chunk first (numpy), then by Spark's partial sums. Forms are followed by pointer doubling: a form has at least RATIO
times the occurrences, so chains are short, and there are no rings.

Cases: a null or empty text has no words; a null id counts as the text ''; repeated rows count as documents of their own;
runs of any length are words; an empty table gives no rows; further columns are ignored."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augeval.llm.textops import LOWER, mix, span_hash, text_chunks, words_of
from augeval.session import cut_lineage

FILTER_BYTES = 32 << 20   # of all filters together, and so of the broadcast
KEY_BITS = 24             # filter bits a word, while FILTER_BYTES allows it
LONG = 32                 # words of this length or longer share a filter
PROBES = 1 << 19          # edits looked up at a time
RATIO = 5
TYPO_EVERY = 199
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)  # fixed value: the polynomial of crc32
    return t


_CRC = _crc_table()
_RUN = np.array([True, False])  # separator table over the marks 0 (outside a run) and 1


def _runs(buf: np.ndarray, offs: np.ndarray):
    """Runs of A-Z, a-z and U+00C0 to U+00FF (two bytes, the first 0xC3)."""
    lead = buf == 0xC3
    inside = lead | ((LOWER[buf] >= 97) & (LOWER[buf] <= 122))
    inside[1:] |= lead[:-1]
    return words_of(inside.view(np.uint8), offs, _RUN)


def run_crc(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from the crc32 of what stands before it; a byte of all spans at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    crc, at, size = ~state[order].astype(np.uint32), starts[order], size[order]
    left = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # spans that reach byte k
    for k, n in enumerate(left):
        crc[:n] = _CRC[(crc[:n] ^ buf[at[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = ~crc
    return out


def _counted(least: int, typo_every: int):
    """Distinct words of a chunk with their occurrences; every ``typo_every``-th run by crc32 loses a code point."""
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                w = _runs(buf, offs)
                if not len(w.starts):
                    continue
                low = LOWER[buf]
                marks = np.concatenate(([0], np.cumsum(buf == 0xC3)))
                points = w.ends - w.starts - (marks[w.ends] - marks[w.starts])
                keep = points >= least
                starts, ends, doc, points = w.starts[keep], w.ends[keep], w.doc[keep], points[keep]
                words, counts = [], []
                if typo_every:
                    state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[lo:hi]], np.uint32)
                    crc = run_crc(low, starts, ends, state[doc])
                    odd = crc % typo_every == 0
                    for s, e, h in zip(starts[odd], ends[odd], crc[odd].tolist(), strict=True):
                        text = low[s:e].tobytes().decode()
                        at = h % len(text)
                        if len(text) > least:
                            words.append(text[:at] + text[at + 1:])
                            counts.append(1)
                    starts, ends = starts[~odd], ends[~odd]
                _, first, n = np.unique(span_hash(low, starts, ends), return_index=True, return_counts=True)
                words += [low[s:e].tobytes().decode() for s, e in zip(starts[first], ends[first], strict=True)]
                counts += n.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])
    return run


def count_words(docs: DataFrame, least_points: int = 6, least_n: int = 5, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(doc_id, text) -> (word, n): words of ``least_points`` code points or more that occur ``least_n`` times or more."""
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = d.mapInArrow(_counted(least_points, typo_every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row and the first of each."""
    at = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64), at


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1), base, np.uint64))))


def _hashed(batches):
    for b in batches:
        words = b.column("word").to_pylist()
        if not words:
            continue
        p, at = _points(words)
        size = np.diff(at)
        place = np.arange(len(p)) - np.repeat(at[:-1], size)
        raw = np.add.reduceat(p * _powers(_BASE, int(size.max()))[place], at[:-1])
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(mix(raw).view(np.int64)), pa.array(size, pa.int32())],
                                         names=["word", "n", "h", "size"])


def vocabulary(counts: DataFrame) -> DataFrame:
    """(word, n) -> word, n, h (hash), size (code points), as a written table."""
    return cut_lineage(counts.mapInArrow(_hashed, "word string, n long, h long, size int"), "vocabulary")


def _place(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and mask (four bits) of each hash."""
    at = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return at.astype(np.int64), mask


def _keys(blocks: dict[int, int]):
    def run(batches):
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            shard = np.minimum(b.column("size").to_numpy(), LONG)
            at, mask = np.zeros(len(h), np.int64), np.zeros(len(h), np.uint64)
            for s in np.unique(shard).tolist():
                own = shard == s
                at[own], mask[own] = _place(h[own], blocks[s])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(at), pa.array(mask.view(np.int64))], names=["shard", "at", "mask"])
    return run


def filters(vocab: DataFrame, limit: int = FILTER_BYTES) -> dict[int, np.ndarray]:
    """A blocked filter of each length: 64-bit blocks, KEY_BITS bits a word or what ``limit`` bytes allow."""
    sizes = {r["shard"]: r["n"] for r in vocab.groupBy(F.least("size", F.lit(LONG)).alias("shard")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    bits = min(KEY_BITS, 8 * limit / max(1, total))
    blocks = {s: max(1, int(n * bits / 64)) for s, n in sizes.items()}
    out = {s: np.zeros(n, np.uint64) for s, n in blocks.items()}
    rows = vocab.mapInArrow(_keys(blocks), "shard int, at long, mask long").groupBy("shard", "at").agg(F.bit_or("mask").alias("mask"))
    t = rows.toArrow()  # a row a block at most: bounded by ``limit``
    shard, at, mask = (t.column(c).to_numpy() for c in ("shard", "at", "mask"))
    for s in out:
        out[s][at[shard == s]] = mask[shard == s].view(np.uint64)
    return out


def _letters(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_points(b.column("word").to_pylist())[0]).astype(np.int64))], names=["letter"])


def _edits(shared):
    """Edits of the words that their length's filter lets pass: (src, cand, place, letter), letter 0 for a deletion."""
    def passed(table, raw):
        h = mix(raw)
        at, mask = _place(h.ravel(), len(table))
        return h, (table[at] & mask == mask).reshape(h.shape)

    def rows(src, cand, place, letter):
        return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(cand.view(np.int64)), pa.array(place, pa.int32()),
                                           pa.array(letter, pa.int32())], names=["src", "cand", "place", "letter"])

    def run(batches):
        tables, letters = shared.value
        for b in batches:
            p, first = _points(b.column("word").to_pylist())
            own, size = b.column("h").to_numpy().view(np.uint64), np.diff(first)
            for n in np.unique(size).tolist():
                power, back = _powers(_BASE, n), np.uint64(_INV)
                same, shorter = tables.get(min(n, LONG)), tables.get(min(n - 1, LONG))
                which, step = np.flatnonzero(size == n), max(1, PROBES // (n * len(letters)))
                for lo in range(0, len(which), step):
                    w = which[lo:lo + step]
                    c = p[first[w][:, None] + np.arange(n)]
                    terms = c * power[:n]
                    raw = terms.sum(1, dtype=np.uint64)
                    if shorter is not None:
                        ahead = np.cumsum(terms, 1, dtype=np.uint64)
                        gone = ahead - terms + (raw[:, None] - ahead) * back
                        h, hit = passed(shorter, gone)
                        hit[:, 1:] &= c[:, 1:] != c[:, :-1]
                        i, j = np.nonzero(hit)
                        if len(i):
                            yield rows(own[w[i]], h[i, j], j, np.zeros(len(i), np.int64))
                    places = max(1, PROBES // (len(w) * len(letters)))
                    for j0 in range(0, n, places) if same is not None else []:
                        part = c[:, j0:j0 + places]
                        i, j, k = np.nonzero(letters[None, None, :] > part[:, :, None])
                        raw2 = raw[i] + (letters[k] - part[i, j]) * power[j0 + j]
                        h, hit = passed(same, raw2)
                        if hit.any():
                            i, j, k = i[hit], j[hit], k[hit]
                            yield rows(own[w[i]], h[hit], j0 + j, letters[k].astype(np.int64))
    return run


def near_pairs(vocab: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): pairs of vocabulary words that one inserted, deleted or replaced code point tells apart, each once."""
    spark = vocab.sparkSession
    letters = sorted(r["letter"] for r in vocab.mapInArrow(_letters, "letter long").distinct().collect())  # 26 + 64 at most
    shared = spark.sparkContext.broadcast((filters(vocab, limit), np.array(letters or [0], np.uint64)))
    found = vocab.select("word", "h").mapInArrow(_edits(shared), "src long, cand long, place int, letter int")
    other = vocab.select(F.col("h").alias("cand"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    word = vocab.select(F.col("h").alias("src"), "word", "n")
    cut = F.expr("concat(substring(word, 1, place), if(letter = 0, '', char(letter)), substring(word, place + 2))")
    return found.join(other, "cand").join(word, "src").where(cut == F.col("other")).select("word", "n", "other", "other_n")


def variants(counts: DataFrame, ratio: int = RATIO, limit: int = FILTER_BYTES) -> DataFrame:
    """(word, n) distinct words -> word, form, root, n, n_near, form_n: each word's near word with the most occurrences (ties:
    the smallest), if it has ``ratio`` times the word's or more, and the last word that the forms lead to."""
    vocab = vocabulary(counts)
    pairs = near_pairs(vocab, limit)
    both = pairs.select("word", F.col("other").alias("form"), F.col("other_n").alias("form_n")) \
        .union(pairs.select(F.col("other").alias("word"), F.col("word").alias("form"), F.col("n").alias("form_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best"))
    counts = vocab.select("word", "n")
    is_form: Column = -F.col("best.order") >= ratio * F.col("n")
    w = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.order")).alias("form_n"))
    w = cut_lineage(w, "variants")
    roots = cut_lineage(w.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                 F.col("further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            break
        roots = step.drop("moved")
    return w.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
