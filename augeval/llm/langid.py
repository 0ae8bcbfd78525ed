"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

Subwords of a word (a run of letters, A-Z in lower case, bytes of other alphabets count as letters) are its pairs and triples
of bytes, with its edges marked, and the whole word, hashed into 2**BITS buckets. A text is the mean of the
embeddings of all its subwords; since the output layer is linear, scoring adds rows of the bucket-by-language table.

The model is fitted in the driver on at most TRAIN_DOCS documents (bounded by this parameter; the first by hash of the id) with a
known language whose crc32(doc_id) mod 4 is not 2. One tenth of the sample calibrates: a temperature by likelihood,
and the score under which a prediction is marked as rejected (REJECT_SHARE of the right calibration answers).

Cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; without any known language everything is ``und``; null
languages are never learned from; rows that repeat an id are all used; long texts are whole; other columns are
ignored; an empty table gives an empty table."""
from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.llm.textops import CHUNK_BYTES, LOWER, crc32_mod, mix, set_batches, span_hash, sparse_rows, text_chunks, words_of

BITS = 16
DIM = 16
FOLDS, HELD_OUT = 4, 2
TRAIN_DOCS = 2500
EPOCHS = 8
RATE = 2.0
ROW_RATE = 8.0          # embedding rows move faster: each has a small share of a text
REJECT_SHARE = 0.005
UNKNOWN = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = True
_ASCII_LETTER[97:123] = True
_NOT_LETTER = ~_ASCII_LETTER
_NOT_LETTER[128:] = False


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray        # bucket x language: embeddings times output layer, divided by the temperature
    reject_below: float


def subwords(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of the texts of a chunk, and the text of each (not in order of the texts)."""
    low = LOWER[buf]
    w = words_of(low, offs, _NOT_LETTER)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Words laid side by side with one mark before and one after each.
    size = w.ends - w.starts
    at = np.cumsum(size + 2) - (size + 2)
    laid = np.zeros(int(size.sum()) + 2 * len(size), np.uint64)
    src = np.flatnonzero(~_NOT_LETTER[low])
    laid[np.arange(len(src)) + 2 * np.repeat(np.arange(len(size)), size) + 1] = low[src]
    doc = np.repeat(w.doc, size + 2)
    two = laid[:-1] * np.uint64(256) + laid[1:]
    three = two[:-1] * np.uint64(256) + laid[2:]
    last = at + size + 1  # place of the closing mark
    keep2, keep3 = np.ones(len(two), bool), np.ones(len(three), bool)
    keep2[last[:-1]] = False
    keep3[last[:-1]] = False
    keep3[last[:-1] - 1] = False
    shift = np.uint64(64 - BITS)
    h2 = (mix(two[keep2] + np.uint64(1 << 40)) >> shift).astype(np.int64)
    h3 = (mix(three[keep3] + np.uint64(1 << 41)) >> shift).astype(np.int64)
    hw = (span_hash(low, w.starts, w.ends) >> shift).astype(np.int64)
    return np.concatenate([h2, h3, hw]), np.concatenate([doc[:-1][keep2], doc[:-2][keep3], w.doc])


def _vectors():
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                f, doc = subwords(buf, offs)
                order = np.argsort(doc, kind="stable")
                f, bounds = f[order], np.searchsorted(doc[order], np.arange(len(offs)))
                got = [np.unique(f[x:y], return_counts=True) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("lang").slice(lo, hi - lo),
                     pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())),
                     pa.array([(c / c.sum()).astype(np.float32) for _, c in got], pa.list_(pa.float32()))],
                    names=["doc_id", "lang", "buckets", "shares"])
    return run


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Fit on a bounded sample of the documents with a known language outside the held-out fold."""
    set_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null and doc_id is not null") \
        .where(crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = known.join(F.broadcast(ids), "doc_id").mapInArrow(_vectors(), "doc_id long, lang string, buckets array<int>, shares array<float>") \
        .where("size(buckets) > 0").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "buckets").limit(limit).toArrow()
    x = sparse_rows(rows, "buckets", "shares")
    return sgd(x, rows.column("lang").to_pylist())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sgd(x, lang: list[str], epochs: int = EPOCHS) -> Model:
    languages = sorted(set(lang))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), 0.0)
    y = np.array([languages.index(v) for v in lang])
    rng = np.random.default_rng(1)
    emb = (rng.random((1 << BITS, DIM)) - 0.5) / DIM
    out = np.zeros((DIM, len(languages)))
    held = np.arange(len(x)) % 10 == 9
    learn = np.flatnonzero(~held)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for k in rng.permutation(learn):
            i, s = x[k]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = s @ emb[i]
            g = _softmax(hidden @ out)
            g[y[k]] -= 1
            back = out @ g
            out -= rate * np.outer(hidden, g)
            emb[i] -= ROW_RATE * rate * s[:, None] * back
    table = emb @ out
    check = np.flatnonzero(held) if held.any() else learn
    z = np.array([x[k][1] @ table[x[k][0]] for k in check])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).sum() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(z / t)
    right = p.argmax(1) == y[check]
    reject = float(np.quantile(p.max(1)[right], REJECT_SHARE)) if right.any() else 0.0
    return Model(languages, (table / t).astype(np.float32), reject)


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[buf], out=total[1:])
    found = total[offs[1:]] > total[offs[:-1]]
    for t in np.flatnonzero(~found & (np.diff(offs) > 0)):
        found[t] = any(unicodedata.category(c)[0] == "L" for c in set(buf[offs[t]:offs[t + 1]].tobytes().decode("utf-8")))
    return found


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x languages floats
    set_batches(docs.sparkSession)

    def run(batches):
        m = sent.value
        k = len(m.languages)
        names = np.array([*m.languages, UNKNOWN], object)
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text"), CHUNK_BYTES // max(1, k // 8)):
                n = len(offs) - 1
                letter = _has_letter(buf, offs) & (k > 0)
                pick, s = np.full(n, k), np.zeros(n)
                if letter.any():
                    f, doc = subwords(buf, offs)
                    count = np.maximum(np.bincount(doc, minlength=n), 1)
                    z = np.stack([np.bincount(doc, m.table[f, j], n) for j in range(k)], 1) / count[:, None]
                    p = _softmax(z)
                    pick[letter], s[letter] = p.argmax(1)[letter], p.max(1)[letter]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(names[pick], pa.string()), pa.array(s), pa.array(letter & (s < m.reject_below) | ~letter)],
                    names=["doc_id", "lang_pred", "score", "rejected"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
