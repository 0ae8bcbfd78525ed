import numpy as np

from augeval.llm.meeting import SCHEMA, met, pack


def test_hot_owner_is_spread_and_its_copies_count_once(spark):
    hot, sigs = 900, np.arange(2000, dtype=np.uint64) * np.uint64(7919)
    chunks, entries = [], {}
    for c in range(5):  # 50 copies of one text and a near copy with a smaller key in every chunk
        sig = np.concatenate([np.tile(sigs, 50), sigs])
        key = np.concatenate([np.full(50 * len(sigs), hot), np.full(len(sigs), 10 + c)])
        chunks.append(pack(sig, key, 24))
        for r in chunks[-1].to_pylist():
            if r["bucket"] < 0:
                entries[r["bucket"]] = entries.get(r["bucket"], 0) + len(r["keys"]) // 8
    assert sum(entries.values()) == 5 * len(sigs)
    assert len(entries) == 24 and max(entries.values()) < 2 * sum(entries.values()) / 24
    rows = [tuple(r.values()) for c in chunks for r in c.to_pylist()]
    got = {(r.sig, r.key, r.lead) for r in met(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(int(s), hot, 10 + c) for s in sigs for c in range(5)} | {(int(s), 10 + c, 10) for s in sigs for c in range(5)}
    assert got == want
