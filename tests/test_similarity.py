"""Largest similarity by falling bands: equal to all pairs on sparse and dense fingerprints; few pairs met on sparse ones."""
import random

import pytest

from augeval.operators import similarity
from augeval.operators.similarity import max_tanimoto


def brute(queries, refs):
    best = {}
    for i, q in queries:
        s = [len(q & r) / len(q | r) for _, r in refs if q | r]
        best[i] = max(s, default=0.0) if q else 0.0
    return best


def fingerprints(seed, n, width, size, near):
    r = random.Random(seed)
    refs = [(i, frozenset(r.sample(range(width), r.randrange(size // 2, size)))) for i in range(n)]
    queries = []
    for i in range(n // 2):
        own = set(refs[r.randrange(n)][1])
        for _ in range(r.choice([0, 1, 2, 5, 20, 60]) if near else 200):
            own.discard(r.choice(sorted(own) or [0]))
            own.add(r.randrange(width))
        queries.append((i, frozenset(own)))
    return queries + [(900, frozenset()), (901, frozenset([width + 5])), (902, queries[0][1])], refs + [(900, frozenset()), (901, refs[0][1])]


def frames(spark, *sides):
    return [spark.createDataFrame([(i, sorted(x, reverse=True)) for i, x in s], "vec_id long, bits array<int>") for s in sides]


@pytest.mark.parametrize("width,size,near", [(2000, 60, True), (2000, 60, False), (40, 30, True)])
def test_equal_to_all_pairs(spark, monkeypatch, width, size, near):
    queries, refs = fingerprints(width, 240, width, size, near)
    q, r = frames(spark, queries, refs)
    got = {x.vec_id: x.max_tanimoto for x in max_tanimoto(q, r).collect()}
    assert got == pytest.approx(brute(queries, refs))
    monkeypatch.setattr(similarity, "WORTH", 1)   # every band is searched
    assert {x.vec_id: x.max_tanimoto for x in max_tanimoto(q, r).collect()} == pytest.approx(got)
    assert {x.max_tanimoto for x in max_tanimoto(q, r.where("vec_id < 0")).collect()} == {0.0}


def test_sparse_fingerprints_meet_few_pairs(spark):
    queries, refs = fingerprints(7, 400, 2000, 60, True)
    q, r = frames(spark, queries, refs)
    freq = similarity._frequencies(r, "bits")
    q, r = (similarity._rare_first(similarity._sets(d, "bits", c), c, freq) for d, c in ((q, "_q"), (r, "_r")))
    met = {m: similarity.met_pairs(q, r, m).count() for m in (0.8, 0.6, 0.4)}
    every = q.count() * r.count()
    assert met[0.8] < every / 10 and met[0.8] < met[0.6] < met[0.4] < every


def brute_nearest(queries, refs, minimum):
    return {i: s if s >= minimum else 0.0 for i, s in brute(queries, refs).items()}


@pytest.mark.parametrize("cells", [1 << 25, 500])
def test_dense_fingerprints_make_no_row_a_pair(spark, monkeypatch, cells):
    monkeypatch.setattr(similarity, "CELLS", cells)
    queries, refs = fingerprints(5, 150, 64, 40, True)
    q, r = frames(spark, queries, refs)
    near = max_tanimoto(q, r)
    assert {x.vec_id: x.max_tanimoto for x in near.collect()} == pytest.approx(brute(queries, refs))
    assert "explode(_q" not in near._jdf.queryExecution().optimizedPlan().toString()   # before: a row for each shared bit of a pair


def test_sparse_rest_is_joined_on_its_bits(spark):
    queries, refs = fingerprints(11, 300, 20000, 30, False)
    q, r = frames(spark, queries, refs)
    near = max_tanimoto(q, r, bands=())
    assert "explode(_q" in near._jdf.queryExecution().optimizedPlan().toString()
    assert {x.vec_id: x.max_tanimoto for x in near.collect()} == pytest.approx(brute(queries, refs))


def test_nearest_at_least_keeps_every_row_and_shuffles_no_fingerprint(spark):
    queries, refs = fingerprints(9, 120, 64, 40, True)
    rows = [(i, sorted(x)) for i, x in queries] + [(None, sorted(queries[0][1])), (0, sorted(queries[1][1])), (7000, None)]
    q = spark.createDataFrame(rows, "vec_id long, bits array<int>")
    near = similarity.nearest_at_least(q, frames(spark, refs)[0], 0.6, "vec_id")
    got = sorted((x.vec_id is not None, x.vec_id or 0, round(x.max_tanimoto, 9)) for x in near.collect())
    best = brute_nearest([(n, frozenset(x or [])) for n, (_, x) in enumerate(rows)], refs, 0.6)
    assert got == sorted((i is not None, i or 0, round(best[n], 9)) for n, (i, _) in enumerate(rows))
    assert "bits" not in near._jdf.queryExecution().optimizedPlan().toString()   # before: joined on the bits of a fingerprint


def test_fingerprint_is_one_column_function(spark):
    import hashlib
    texts = {1: "One two  one TWO three", 2: "", 3: None, 4: "é-Å x"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fp = similarity.fingerprint(d, "text", 256, 2)

    def bits(text):
        w = [x for x in text.lower().replace("-", " ").split(" ") if x]
        grams = {" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        return sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 256 for g in grams})
    assert {x.doc_id: x.bits for x in fp.collect()} == {i: None if t is None else bits(t) for i, t in texts.items()}
    assert "conv(" not in fp._jdf.queryExecution().optimizedPlan().toString()   # before: a chain of expressions for each gram
