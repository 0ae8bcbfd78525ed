import numpy as np
import pytest
from pyspark.sql import functions as F

from augeval.llm import hard_negatives
from augeval.llm.hard_negatives import mine, vertical_scan, whole_vectors


def brute(rows, is_anchor, k=5, m=3):
    seen, out = set(), []
    for a in rows:
        key = (a[0], a[1], tuple(a[2]))
        if not is_anchor(a[0]) or key in seen:
            continue
        seen.add(key)
        s = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1] == a[1]) for r in rows if r[0] != a[0] and len(r[2]) == len(a[2]))
        for p, pid, _ in [x for x in s if x[2]][:k]:
            n = [x for x in s if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p][:m]
            out += [(a[0], pid, i + 1, nid, -p, -v) for i, (v, nid, _) in enumerate(n)]
    return sorted(out)


def test_equal_to_all_pairs(spark, frame, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-40, 90, 20).tolist()) for i in range(600)]
    rows += [(i + 600, i % 4, rows[7][2]) for i in range(40)]            # ties
    rows += [rows[3]] * 3 + [(50, 1, rows[9][2]), (900, 2, [])]          # repeated rows, a repeated anchor id, an empty vector
    rows += [(901 + i, i % 3, rng.integers(-9, 9, 7).tolist()) for i in range(30)]
    d = frame(rows, "vec_id long, label int, vec array<bigint>")
    want = brute(rows, lambda i: i % 10 == 0)
    for passes in (1, 3):
        monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 16 << 20 if passes == 1 else 5000)
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 << 20 if passes == 1 else 6000)
        got = sorted(tuple(r) for r in mine(d.repartition(3), F.col("vec_id") % 10 == 0).collect())
        assert got == want and len(want) > 300


def test_scan_drops_candidates_early():
    rng = np.random.default_rng(1)
    cols = rng.integers(-100, 100, (64, 5000)).astype(float)
    cols[:, 0] = 99
    q, left = np.full(64, 90.0), []

    def alive(low, high):
        left.append(len(low))
        return high >= np.partition(low, -1)[-1]
    cand, score = vertical_scan(cols, np.arange(5000), q, np.arange(64), cols.min(1), cols.max(1), alive)
    assert cand.tolist() == [0] and score[0] == 64 * 90 * 99 and left[-1] < 5000 / 100


def test_rows_that_take_no_part(spark, frame):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.6, 0.4]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [float("nan"), 1.0]),
            (6, 2, [float("inf"), 1.0]), (7, 2, [None, 1.0]), (None, 2, [0.6, 0.4])]
    d = frame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, anchor string")
    v = whole_vectors(d)
    assert sorted(r.vec_id for r in v.collect()) == [0, 1, 2]
    got = mine(v, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 256 * 256 + 128 * 128, 256 * 153 + 128 * 102)]
    assert mine(v.where("vec_id > 9"), F.col("vec_id") == 0).count() == 0


def test_inexact_scores_fail(spark, frame):
    d = frame([(0, 1, [1 << 40]), (1, 1, [1 << 40])], "vec_id long, label int, vec array<bigint>")
    with pytest.raises(Exception, match="not exact"):
        mine(d, F.col("vec_id") == 0).collect()
