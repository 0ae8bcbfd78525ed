"""Meeting points: which signatures are held by several owners, by one shuffle of packed arrays.

Chunks send (signature, owner) pairs packed by bucket. A signature that a chunk holds for several owners sends its smallest
owner only; the others go out under negative buckets together with that leader, so a hot signature costs one entry a
chunk and nothing waits for all its owners. Each bucket is sorted and neighbours are compared."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from augeval.llm.textops import mix, set_batches

SCHEMA = "bucket long, sigs binary, keys binary, leads binary"
NAMES = ["bucket", "sigs", "keys", "leads"]


def pack(sig: np.ndarray, key: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """Pairs (unsigned signature, signed owner) of a chunk as packed rows."""
    if not len(sig):
        return None
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    lead = key[new][np.cumsum(new) - 1]
    other = ~new & (key != lead) & np.concatenate(([True], key[1:] != key[:-1]))
    rows = _by_bucket((sig[new] % np.uint64(buckets)).astype(np.int64), sig[new], key[new], key[new])
    if other.any():
        other = np.flatnonzero(other)
        other = other[np.argsort(key[other], kind="stable")]  # equal owners side by side pack well
        side = -1 - (mix(sig[other] ^ mix(key[other].view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        rows = [x + y for x, y in zip(rows, _by_bucket(side, sig[other], key[other], lead[other]), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=NAMES)


def _by_bucket(bucket, sig, key, lead):
    order = np.argsort(bucket, kind="stable")
    bucket, sig, key, lead = bucket[order], sig[order], key[order], lead[order]
    at = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    own = bool((bucket < 0).any())
    out = [[], [], [], []]
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        out[0].append(int(bucket[lo]))
        out[1].append(sig[lo:hi].tobytes())
        out[2].append(key[lo:hi].tobytes())
        out[3].append(lead[lo:hi].tobytes() if own else b"")
    return out


def _met(table: pa.Table) -> pa.Table:
    """(sig, key, lead) rows of the signatures of one bucket that several owners hold."""
    join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    sig, key = join("sigs", np.uint64), join("keys", np.int64)
    if table.column("bucket")[0].as_py() < 0:
        lead = join("leads", np.int64)
    else:
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.concatenate(([True], sig[1:] != sig[:-1]))
        at = np.cumsum(new) - 1
        lead = key[new][at]
        several = np.zeros(int(at[-1]) + 1, bool)
        several[at[key != lead]] = True
        keep = several[at] & (new | np.concatenate(([True], key[1:] != key[:-1])))
        sig, key, lead = sig[keep], key[keep], lead[keep]
    return pa.table({"sig": sig.view(np.int64), "key": key, "lead": lead})


def met(entries: DataFrame) -> DataFrame:
    """Packed entries -> (sig, key, lead) of every owner of a signature with several owners. The smallest owner of a
    signature within a chunk is ``lead`` of that chunk's others; across chunks the smallest of those leads them."""
    set_batches(entries.sparkSession)
    return entries.groupBy("bucket").applyInArrow(_met, "sig long, key long, lead long")
