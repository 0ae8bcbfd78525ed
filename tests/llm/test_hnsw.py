import numpy as np

from augeval.llm.hnsw import Graph, audited_links, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, t):
    u = {i: (lab, np.array(v, float)) for i, v, lab in rows if i is not None}
    ok = {i for i, (lab, v) in u.items() if lab is not None and v.ndim == 1 and len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = {i: set() for i in u}
    for a in ok:
        for b in ok:
            (la, x), (lb, y) = u[a], u[b]
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                links[a].add(b)
    low = {i: i for i in u}
    for _ in range(len(u)):
        new = {i: min([low[i], *[low[j] for j in links[i]]]) for i in u}
        if new == low:
            break
        low = new
    return {i: (len(links[i]), low[i], low[i] == i) for i in u}


def test_matches_brute_force_over_several_shards(spark, frame):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for lab in (0, 1, None):
        for _ in range(60):
            c = r.normal(size=16)
            for _ in range(int(r.integers(1, 6))):
                rows.append((n * 3, (c + r.normal(size=16) * 0.08).astype(np.float32).tolist(), lab))
                n += 1
    hot = r.normal(size=16)
    rows += [((n + k) * 3, (hot + r.normal(size=16) * 0.05).astype(np.float32).tolist(), 1) for k in range(150)]
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (4, [1.0, float("nan")], 0), (5, [None, 1.0], 0), (7, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (10, [], 0)]
    got = near_duplicates(frame([(*x, "z") for x in rows], SCHEMA), shard=120).collect()
    want = brute(rows, 0.98)
    assert len(got) == len(rows)
    same = sum((r.n_links, r.component_id, r.kept) == want[r.vec_id] for r in got)
    assert same >= 0.99 * len(rows)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)


def test_hot_group_is_found_whole():
    r = np.random.default_rng(4)
    hot = r.normal(size=32)
    x = np.concatenate([r.normal(size=(900, 32)), hot + r.normal(size=(600, 32)) * 0.03])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.build(x.astype(np.float32), np.arange(len(x)))
    found, recall, _ = audited_links(g, x.astype(np.float32), 0.98)
    truth = x @ x.T >= 0.98
    assert recall >= 0.98 and (found & truth).sum() >= 0.98 * truth.sum()


def test_nulls_repeats_and_empty(spark, frame):
    rows = [(None, [1.0, 0.0], 0, "a"), (1, [1.0, 0.0], 0, "a"), (1, [1.0, 0.0], 0, "a"), (2, [1.0, 0.0], 0, "b")]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicates(frame(rows, SCHEMA)).collect())
    assert got == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert near_duplicates(frame([], SCHEMA)).count() == 0


def test_audit_sees_small_groups_beside_a_hot_one():
    r = np.random.default_rng(5)
    hot, pair = r.normal(size=32), r.normal(size=(150, 32))
    x = np.concatenate([r.normal(size=(600, 32)), hot + r.normal(size=(600, 32)) * 0.03, pair, pair + r.normal(size=(150, 32)) * 0.01])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for own in (None, np.arange(len(x))):
        g = Graph.build(x, np.arange(len(x)))
        lost = np.arange(1350, 1500)  # no edge leads to or from the second of each pair
        for t in g.tables:
            t[lost] = -1
            t[np.isin(t, lost)] = -1
        g.entry = 0
        truth = x.astype(float) @ x.astype(float).T >= 0.98
        np.fill_diagonal(truth, False)
        found, recall, _ = audited_links(g, x, 0.98, own)
        assert recall >= 0.98 and (found & truth)[1200:].sum() >= 0.98 * truth[1200:].sum()


def test_several_large_shards_with_a_hot_group(spark, frame):
    r = np.random.default_rng(6)
    hot, pair = r.normal(size=16), r.normal(size=(300, 16))
    x = np.concatenate([r.normal(size=(300, 16)), hot + r.normal(size=(400, 16)) * 0.03, pair, pair + r.normal(size=(300, 16)) * 0.02]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    got = near_duplicates(frame([(k, v.tolist(), 0, "z") for k, v in enumerate(x)], SCHEMA), shard=450).collect()
    n = np.zeros(len(x), int)
    for row in got:
        n[row.vec_id] = row.n_links
    small = np.r_[0:300, 700:1300]
    assert (n <= want).all() and n[small].sum() >= 0.98 * want[small].sum() and n.sum() >= 0.98 * want.sum()
