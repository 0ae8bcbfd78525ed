import random
import re

import numpy as np
import pyarrow as pa
import pytest

from augeval.llm import jaccard_join
from augeval.llm.jaccard_join import (BOUND_COORDS, FINE_COORDS, _counts, _leaf_pairs, _leaf_rows, _within_bound, block_points, fine_point,
                                      join_leaves, leaf_point, link_components, pack_point, slim_point, unpack_point)
from augeval.llm.textops import shingle_sets, text_chunks


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(docs, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in docs]
    low = {i: i for i, _ in docs}
    again = True
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and den * len(s & t) >= num * len(s | t)]
    while again:
        again = False
        for a, b in links:
            m = min(low[a], low[b])
            again |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(s), low[i]) for i, s in sets}


def corpus(seed, groups=8, copies=25):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    docs = [[r.choice(vocab) for _ in range(r.choice([1, 2, 5, 12, 40, 160, 400]))] for _ in range(60)]
    line = [r.choice(vocab) for _ in range(14)]
    for g in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([12, 30, 90, 150, 700]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append(w if r.random() < .7 else line + w)
    texts = [" ".join(w) for w in docs] + ["", None, "  \n", "Same TEXT here now", "same text\there now", "É é", "é é"]
    r.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, frame, n, num, den):
    docs = corpus(n)
    got = link_components(frame(docs, "doc_id long, text string"), n, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, n, num, den)


@pytest.mark.parametrize("num", [90, 80])
def test_linked_sets_share_a_block_point(num):
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(2, 500))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        extra = int(len(a) * (100 - num) / (100 + num))
        b = a[int(r.integers(0, extra + 1)):]
        b = np.unique(np.concatenate([b, r.integers(0, 2**64, int(r.integers(0, extra + 1)), dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if len(a) == len(b) == inter or 100 * inter < num * (len(a) + len(b) - inter):
            continue
        points = []
        for s in (a, b):  # each in a chunk of its own
            sig, _ = block_points(s, np.array([0, len(s)]), num, 100)
            points.append(set(sig.tolist()))
        assert points[0] & points[1]


def test_leaves_bound_and_span():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], r.integers(0, 2**64, k, dtype=np.uint64)])) for k in range(6)]
    far = r.integers(0, 2**64, 100, dtype=np.uint64)
    side = [(k, k, _counts([s])[0].astype(np.uint16).tobytes()) for k, s in enumerate([*sets, far])]
    linked = {(a, b) for a in range(6) for b in range(a)}
    assert linked >= set(join_leaves(side, side, 90, 100, False)) >= {(a, a - 1) for a in range(1, 6)}
    assert len(join_leaves(side, side, 90, 100, True)) == 5
    assert len(join_leaves(side, [(9, 9, None)], 90, 100, False)) == 7


def test_shingles_do_not_depend_on_the_chunk():
    texts = pa.array(["a b c d", None, "x", "", "A B c\td", "a b"])
    whole = [shingle_sets(buf, offs, 3) for _, _, buf, offs in text_chunks(texts)][0]
    for i, t in enumerate(texts):
        for _, _, buf, offs in text_chunks(pa.array([t], pa.string())):
            h, _ = shingle_sets(buf, offs, 3)
            assert h.tolist() == whole[0][whole[1][i]:whole[1][i + 1]].tolist()


def test_nulls_repeats_empty_and_other_columns(spark, frame):
    rows = [(None, "a b c d", 1), (1, "a b c d", 2), (1, "a b c d", 3), (4, None, None), (4, "e f g h", 5)]
    got = link_components(frame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got if r.doc_id) == [
        (1, 2, 1), (1, 2, 1), (4, 0, 4), (4, 2, 4)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert link_components(frame([], "doc_id long, text string")).count() == 0


def test_components_by_stars_and_in_one_task(spark, frame):
    from augeval.llm.graph import connected_components
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3), (5, None)]
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a in low and b in low and a is not None and b is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    e = frame(edges, "a long, b long")
    for bound in (0, 10_000):
        assert {x.node: x.component for x in connected_components(e, bound).collect()} == low
    assert connected_components(frame([], "a long, b long")).count() == 0


def test_points_keep_their_counts():
    for top in (0, 255, 256, 65535):
        counts = np.arange(BOUND_COORDS) % (top + 1)
        counts[7] = top
        packed = pack_point(counts)
        assert len(packed) == BOUND_COORDS * (1 if top < 256 else 2) and (unpack_point(packed) == counts).all()
    assert pack_point(np.full(BOUND_COORDS, 65536)) is None


def test_points_of_small_counts_take_half_a_byte():
    rng = np.random.default_rng(4)
    for top, size in ((15, BOUND_COORDS // 2), (16, BOUND_COORDS), (255, BOUND_COORDS), (256, 2 * BOUND_COORDS)):
        counts = rng.integers(0, top + 1, BOUND_COORDS).astype(np.int32)
        counts[3] = top
        assert len(slim_point(counts)) == size and (unpack_point(slim_point(counts)) == counts).all()


def test_rows_repeated_with_their_text(spark, frame):
    docs = corpus(11, groups=3, copies=12)
    rows = docs + docs[:40] + docs[:40]
    got = link_components(frame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    want = brute(docs, 5, 80, 100)
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_more_pairs_than_are_sent(spark, frame, monkeypatch):
    monkeypatch.setattr("augeval.llm.jaccard_join.BROADCAST_BYTES", -1)
    docs = corpus(23, groups=2, copies=10)
    got = link_components(frame(docs, "doc_id long, text string"), 5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, 5, 80, 100)


def test_fine_points_tell_long_unrelated_sets_apart():
    rng = np.random.default_rng(7)
    sets, pairs = [], []
    for n in (600, 1100, 5000, 20_000):  # by twos: no shingle in common; then sets of several sizes that just link at 0.8
        h = np.sort(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        rng.shuffle(h)
        for other in (h[n:], np.concatenate([h[:n - n // 9], h[n:n + n // 9]]), h[:-(-n * 4 // 5)]):
            pairs.append((len(sets), len(sets) + 1))
            sets += [h[:n], other]
    frame = lambda points: pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs]), pa.array([points[x] for x, _ in pairs], pa.binary()),
         pa.array([points[y] for _, y in pairs], pa.binary())], names=["a", "b", "pa", "pb"])

    def linked(points, **unpack):
        out = list(_within_bound(8, 10, **unpack)(iter([frame(points)])))
        return list(zip(out[0].column("a").to_pylist(), out[0].column("b").to_pylist(), strict=True))
    coarse = linked([pack_point(c) for c in _counts(sets)])
    assert coarse[-3:] == pairs[-3:]  # long sets all pass the bound of 256 coordinates
    fine = [fine_point(s) for s in sets]
    assert all(p is None or len(p) <= FINE_COORDS for p in fine) and len({len(p) for p in fine if p}) > 3
    assert linked(fine, unpack=lambda p: np.frombuffer(p, np.uint8)) == [p for i, p in enumerate(pairs) if i % 3]
    assert fine_point(sets[0][:512]) is None and fine_point(np.repeat(sets[0], 300)) is None


def test_long_texts(spark, frame):
    r = random.Random(9)
    rows = []
    for i in range(12):  # pairs of 700 to 4,000 words that link, and that just do not
        words = [r.choice("abcdefgh") + str(r.randrange(5000)) for _ in range(700 + 300 * i)]
        near = list(words)
        for at in r.sample(range(len(words)), len(words) // (40 if i % 2 else 25)):
            near[at] = "z" + str(at)
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(near))]
    got = {x.doc_id: x.component_id for x in link_components(frame(rows, "doc_id long, text string"), 3, 80, 100).collect()}
    sets = {k: {tuple(w[j:j + 3]) for j in range(len(w) - 2)} for k, w in ((k, t.split(" ")) for k, t in rows)}
    links = {k for k in range(0, 120, 10) if 100 * len(sets[k] & sets[k + 1]) >= 80 * len(sets[k] | sets[k + 1])}
    assert 0 < len(links) < 12
    assert got == {k: k - k % 10 if k - k % 10 in links else k for k, _ in rows}


def test_leaves_tell_long_sets_apart_and_compare_a_pair_once():
    r = np.random.default_rng(13)
    base = r.integers(0, 2**63, 9000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[300 * k:], r.integers(0, 2**63, 300 * k).astype(np.uint64)])) for k in range(4)]
    sets += [np.unique(r.integers(0, 2**63, 9000).astype(np.uint64)) for _ in range(12)]
    side = [(k, k, slim_point(_counts([s])[0])) for k, s in enumerate(sets)]
    fine = [leaf_point(fine_point(s)) for s in sets]
    assert len(join_leaves(side, side, 80, 100, False)) == 16 * 15 // 2  # 256 coordinates let all pairs of such sets pass
    linked = {(a, b) for a in range(4) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    lean = [(k, k, None) for k in range(16)]
    assert linked <= set(join_leaves(lean, lean, 80, 100, False, (fine, fine))) <= {(a, b) for a in range(4) for b in range(a)}
    assert leaf_point(fine_point(sets[0][:2048])) is None and leaf_point(None) is None
    before = [[5], [5, 7], [7], [], *[[k] for k in range(100, 112)]]
    assert set(join_leaves(side, side, 80, 100, False, None, (before, before))) == {
        (a, b) for a in range(16) for b in range(a)} - {(1, 0), (2, 1)}


def test_a_pair_of_many_nodes_is_a_candidate_once(frame, monkeypatch):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], r.integers(0, 2**63, k).astype(np.uint64)])) for k in range(30)]
    held = frame([(k, bytearray(slim_point(_counts([s])[0])), None) for k, s in enumerate(sets)], "key long, point binary, leaf_point binary")
    nodes = [(sig, sorted(r.choice(30, 20, replace=False).tolist())) for sig in range(-20, 20)]
    member = frame([(sig, k, k, 20) for sig, keys in nodes for k in keys], "sig long, key long, comp long, size long")
    want = {(a, b) for _, keys in nodes for a in keys for b in keys if a > b}
    for leaf in (2048, 8):  # nodes of one leaf and of three
        monkeypatch.setattr("augeval.llm.jaccard_join.LEAF", leaf)
        rows = _leaf_rows(member, held).toArrow().to_batches()
        made = [(x, y) for b in _leaf_pairs(80, 100, False)(iter(rows)) for x, y in zip(*(b.column(c).to_pylist() for c in ("a", "b")), strict=True)]
        assert set(made) == want
        assert len(made) < 1.5 * len(want) < 40 * 190  # 40 nodes of 190 pairs


def test_steps_without_candidates_run_no_jobs(spark, frame):
    """The driver's threads and plans grow with the jobs: copies that the first star joins leave nothing for the later steps."""
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghijkl") + str(r.randrange(900)) for _ in range(60)) for _ in range(6)]
    docs = [(i, base[i % 6] + (" end" if i >= 6 else "")) for i in range(12)]
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "few-jobs")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in link_components(frame(docs, "doc_id long, text string"), 3, 90, 100).collect()}
    sc._jsc.clearJobGroup()
    assert got == brute(docs, 3, 90, 100)
    assert len(sc.statusTracker().getJobIdsForGroup("few-jobs")) <= 90


def test_components_of_a_known_bound_of_edges(frame):
    from augeval.llm.graph import connected_components
    e = frame([(5, 2), (2, 5), (5, 2), (9, 5), (7, 7), (None, 3), (8, 4)], "a long, b long")
    want = {2: 2, 5: 2, 9: 2, 4: 4, 8: 4}
    for bound in (None, 7):
        assert {x.node: x.component for x in connected_components(e, at_most=bound).collect()} == want
    assert {x.node: x.component for x in connected_components(e, 1, 7).collect()} == want
    assert connected_components(frame([], "a long, b long"), at_most=0).count() == 0


def test_sets_leave_the_nodes_of_a_common_passage(spark, frame, monkeypatch):
    """Texts with rarer nodes than those of a passage that all hold are not compared there, and none of their links is lost."""
    r = random.Random(17)
    passage = [f"p{k}" for k in range(120)]
    docs = []
    for i in range(90):
        own = [f"w{r.randrange(10**6)}" for _ in range(340)]
        docs.append(passage + own)
        if i % 6 == 0:  # copies that just link, one of them beside the passage's end
            docs += [passage + own[:305] + [f"x{i}-{k}" for k in range(k0, k0 + 20)] for k0 in (0, 50)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    compared, leaves = [], jaccard_join._leaf_rows
    monkeypatch.setattr(jaccard_join, "_leaf_rows", lambda member, held: compared.append(member.count()) or leaves(member, held))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in link_components(frame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    want = brute(rows, 5, 80, 100)
    assert got == want and len({c for _, c in want.values()}) == 90
    assert sum(compared) < len(docs)


def test_pairs_of_left_large_nodes_are_found(frame):
    """Any two sets that share as many nodes as a link must meet in a large node of both or in as many small ones as asked for."""
    r = random.Random(29)
    sizes = {k: r.choice([8, 30, 60, 90, 300, 700]) for k in range(80)}
    lists = [sorted(r.sample(range(80), r.choice([2, 5, 12, 20, 40, 60]))) for _ in range(120)]
    member = [(sig, k, k, len(keys), weight) for sig, keys in enumerate(lists) for weight in [r.choice([1, 1, 3])] for k in keys]
    out = jaccard_join._left_largest(frame(member, "sig long, key long, comp long, size long, nodes long"),
                                     frame(list(sizes.items()), "key long, n long"), 700, 80, 100).collect()
    small = [x for x in out if x.size <= jaccard_join.SMALL]
    assert len(small) == sum(size <= jaccard_join.SMALL for *_, size, _ in member) and len(out) < 0.9 * len(member)
    stay = {(x.sig, x.key) for x in out if x.size > jaccard_join.SMALL}
    by_sig = {}
    for x in small:
        by_sig.setdefault(x.sig, []).append({"key": x.key, "comp": x.comp, "n": x.n, "large": x.large, "left": x.left})
    weight = {sig: w for sig, *_, w in member}
    batch = pa.RecordBatch.from_pylist([{"members": m, "nodes": weight[sig]} for sig, m in by_sig.items()])
    found = {}
    for b in jaccard_join._pairs(80, 100)(iter([batch])):
        for x in b.to_pylist():
            pair = frozenset((x["a"], x["b"]))
            found[pair] = found.get(pair, False) or x["met"] >= x["least"]
    checked = 0
    for a in range(80):
        for b in range(a):
            n = min(sizes[a], sizes[b])
            shared = [sig for sig, keys in enumerate(lists) if a in keys and b in keys]
            if 100 * n >= 80 * max(sizes[a], sizes[b]) and sum(weight[s] for s in shared) >= jaccard_join.shared_nodes(n, 80, 100):
                checked += 1
                assert any((s, a) in stay and (s, b) in stay for s in shared) or found.get(frozenset((a, b)))
    assert checked > 100
