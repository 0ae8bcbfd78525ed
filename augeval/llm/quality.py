"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters (bytes of other alphabets count as letters), of digits, or of one other character; white space only
separates. Features are the tokens, their pairs, a mark for a token that repeats the one before, and a mark for the
case of a word, hashed into 2**BITS buckets. A text's vector holds each bucket's share of its features (times
SCALE), so a score is the mean of the weights of all features of the whole text: a sparse dot product.

The model is fitted in the driver on at most TRAIN_DOCS labelled documents (bounded by this parameter; the first by hash of
the id) whose crc32(doc_id) mod 5 is not 0. Only text enters a score.

Cases: a null or empty text has no features and gets the score of the bias; documents or labels that repeat an id are
all used, with the lowest label; labels that are null are not learned from; without any label the model scores 0.5;
long texts are whole; other columns are ignored; an empty table gives an empty table."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.llm.textops import LOWER, crc32_mod, mix, segment_sum, set_batches, span_hash, sparse_rows, text_chunks

BITS = 18
SCALE = 30.0
FOLDS = 5
TRAIN_DOCS = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5

# Byte classes: 0 separator, 1 letter, 2 digit, and one class for each other character.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:33] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts of a chunk, and the bounds of each text."""
    docs = len(offs) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
    cls = _CLASS[buf]
    edge = np.ones(len(buf), bool)
    edge[1:] = cls[1:] != cls[:-1]
    head = offs[:-1]
    edge[head[head < len(buf)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(buf))
    real = cls[starts] > 0
    starts, ends = starts[real], ends[real]
    first = np.searchsorted(starts, offs)
    own = np.repeat(np.arange(docs), np.diff(first))
    h = span_hash(LOWER[buf], starts, ends)
    upper = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf >= 65) & (buf <= 90), out=upper[1:])
    shape = np.minimum(upper[ends] - upper[starts], 2) + 3 * ((upper[ends] - upper[starts]) == (ends - starts))
    kind = mix(cls[starts].astype(np.uint64) * np.uint64(64) + shape.astype(np.uint64) + np.uint64(0x51ED270B))
    pair = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    pair[h[:-1] == h[1:]] = np.uint64(0x7EA7)
    joined = np.flatnonzero(own[:-1] == own[1:])
    every = np.concatenate([h, kind, pair[joined]])
    where = np.concatenate([own, own, own[joined]])
    order = np.argsort(where, kind="stable")
    return (every[order] >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(where[order], np.arange(docs + 1))


def _vectors():
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                f, bounds = features(buf, offs)
                got = [np.unique(f[x:y], return_counts=True) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("quality").slice(lo, hi - lo),
                     pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())),
                     pa.array([c.astype(np.float32) for _, c in got], pa.list_(pa.float32()))],
                    names=["doc_id", "quality", "buckets", "counts"])
    return run


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    set_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").where(crc32_mod(F.col("doc_id"), FOLDS) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = d.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = d.join(F.broadcast(ids), "doc_id").mapInArrow(_vectors(), "doc_id long, quality int, buckets array<int>, counts array<float>") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.col("buckets")).limit(limit).toArrow()
    x = [(i, SCALE * c / max(1.0, float(c.sum()))) for i, c in sparse_rows(rows, "buckets", "counts")]
    return ftrl(x, rows.column("quality").to_numpy())


def ftrl(x, y, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal: z and n per bucket, weights follow from them at each example (fixed order of examples)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(1)

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(x)):
            i = np.append(x[k][0], 1 << BITS)
            v = np.append(x[k][1], 1.0)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y[k]) * v
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weight(np.arange(len(z)))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` plus score (probability of label 1, double)."""
    names = [c for c in docs.columns if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats
    set_batches(docs.sparkSession)

    def run(batches):
        m = sent.value
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                f, bounds = features(buf, offs)
                total = segment_sum(m.weights[f].astype(np.float64), bounds)
                s = m.bias + SCALE * total / np.maximum(np.diff(bounds), 1)
                p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*names, "score"])

    d = docs.select(*names)
    from pyspark.sql.types import DoubleType, StructField, StructType
    return d.mapInArrow(run, StructType([*d.schema.fields, StructField("score", DoubleType())]))
