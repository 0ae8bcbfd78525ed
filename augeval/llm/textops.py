"""Vectorised word, hash and n-gram helpers over UTF-8 buffers (numpy, no per-character Python).

Texts arrive as Arrow string columns; a batch is cut into chunks of bounded bytes (one text longer than the bound is
a chunk of its own), so that memory is bounded by the longest text, never by the batch."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

# Word separators of the contracts: space and the control characters 0x09-0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, 1 << 16)
        _POW = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))))
        _IPOW = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, _INV, np.uint64))))
    return _POW, _IPOW


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each chunk; a null text is empty."""
    arr = column.fill_null("") if column.null_count else column
    arr = arr.cast(pa.large_string())
    _, off_buf, data_buf = arr.buffers()
    n = len(arr)
    if n == 0:
        return
    offs = np.frombuffer(off_buf, np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


@dataclass
class Words:
    """Words of a chunk: byte spans, the text each belongs to, and the first word of each text."""
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # len = texts + 1


def words_of(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    n, docs = len(buf), len(offs) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(docs + 1, np.int64))
    inside = ~separator[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(starts, ends, doc, first)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (equal bytes give equal hashes wherever they stand)."""
    n = len(buf)
    pw, ip = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pw[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * ip[starts] + (ends - starts).astype(np.uint64))


def ngram_hash(wh: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive word hashes from each position on (length len(wh) - n + 1, texts not told apart)."""
    m = len(wh) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    # Polynomial of a + b words: that of the first a, shifted by b words, plus that of the next b.
    done, width, part, out = 0, 1, wh, None
    while True:
        if n & width:
            out = part if out is None else out[:len(part) - done] * np.uint64(pow(base, width, 1 << 64)) + part[done:]
            done += width
        if done == n:
            return mix(out[:m])
        part = part[:-width] * np.uint64(pow(base, width, 1 << 64)) + part[width:]
        width *= 2


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text (A-Z in lower case) as (hashes sorted within each text, text bounds).

    With fewer than n words the whole sequence is the one shingle; without words the set is empty."""
    low = LOWER[buf]
    w = words_of(low, offs)
    docs = len(offs) - 1
    wh = span_hash(low, w.starts, w.ends)
    count = np.diff(w.first)
    grams = ngram_hash(wh, n)
    here = np.arange(len(grams))
    whole = here + n <= w.first[1:][w.doc[:len(grams)]] if len(grams) else np.zeros(0, bool)
    h, d = grams[whole], w.doc[:len(grams)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short):
            part = wh[w.first[t]:w.first[t + 1]]
            extra[i] = ngram_hash(part, len(part))[0] ^ np.uint64(0xA5A5A5A5A5A5A5A5 + len(part))
        h, d = np.concatenate([h, extra]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(docs + 1))


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds (empty segments give 0)."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def crc32_mod(doc_id, modulus: int):
    """Column: crc32 of the id as text, modulo ``modulus`` (the folds of the contracts)."""
    from pyspark.sql import functions as F
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def set_batches(spark, records: int = 1000) -> None:
    """Bound the rows and the bytes of an Arrow batch sent to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sparse_rows(table, index: str, value: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of two list columns of equal lengths as numpy slices (no Python object per element)."""
    out = []
    for i, v in zip(table.column(index).chunks, table.column(value).chunks, strict=True):
        at = i.offsets.to_numpy()
        idx, val = i.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)
        start = v.offsets.to_numpy()
        out += [(idx[a:b], val[c:c + b - a]) for a, b, c in zip(at[:-1], at[1:], start[:-1], strict=True)]
    return out
