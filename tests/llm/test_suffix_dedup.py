import random
import re
from collections import defaultdict

from augeval.llm.suffix_dedup import cut_passages, find_passages


def brute(docs, n):
    """Every n-word window of every text, grouped; windows of several ids, joined where they overlap."""
    where = defaultdict(set)
    words = {}
    for i, t in docs:
        if i is None or t is None:
            continue
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        words[i, t] = spans
        for k in range(len(spans) - n + 1):
            where[tuple(t[a:b] for a, b in spans[k:k + n])].add((i, t, k))
    late, lead = defaultdict(dict), {}
    for at in where.values():
        ids = {i for i, _, _ in at}
        if len(ids) > 1:
            for i, t, k in at:
                late[i, t, i == min(ids)][k] = min(ids)
    out = []
    for (i, t, first), at in late.items():
        run = []
        for k in [*sorted(at), None]:
            if run and (k is None or k >= run[-1] + n):
                s = words[i, t]
                out.append((i, s[run[0]][0], s[run[-1] + n - 1][1], run[0], run[-1] + n - run[0], first))
                run = []
            run.append(k)
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"wé{k}" for k in range(800)]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [some(r.choice([30, 49, 50, 51, 80, 200])) for _ in range(9)]
    docs = []
    for _ in range(70):
        w = some(r.choice([0, 3, 40, 60, 150]))
        for _ in range(r.randrange(0, 3)):
            w += r.choice(passages) + some(r.choice([0, 1, 7, 30]))
        docs.append(w)
    near = some(300)
    for _ in range(30):
        w = list(near)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append(w)
    texts = [r.choice(["", " "]) + r.choice([" ", "\n", "  "]).join(w) for w in docs]
    texts += [" ".join(docs[5]), " ".join(near), " ".join(near), None, "", " ".join(passages[5] * 3)]
    r.shuffle(texts)
    return [(3 * i, t) for i, t in enumerate(texts)]


def test_passages_match_brute_force(spark, frame):
    docs = corpus(4) + [(None, "x " * 90), (3, " ".join(f"a{k}" for k in range(70)))]
    got = find_passages(frame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.start_word, r.n_words, r.is_first) for r in got) == brute(docs, 50)
    texts = dict(docs)
    named = {}
    for r in got:
        if r.doc_id != 3:
            assert named.setdefault(tuple(texts[r.doc_id][r.start:r.end].split()), r.passage) == r.passage


def test_cut_leaves_first_occurrences(spark, frame):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"a b {p} c", "x"), (2, f"{p} d", "y"), (2, f"{p} d", "y"), (3, "e f", "z"), (4, None, None), (None, p, "n"), (5, p, "w"), (6, p, "w")]
    got = cut_passages(frame(rows, "doc_id long, text string, start string")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.start or "") for r in got) == sorted(
        [(1, f"a b {p} c", "x"), (2, " d", "y"), (2, " d", "y"), (3, "e f", "z"), (4, "", ""), (0, p, "n"), (5, "", "w"), (6, "", "w")])


def test_empty(spark, frame):
    assert find_passages(frame([], "doc_id long, text string")).count() == 0
    assert cut_passages(frame([(1, "a b")], "doc_id long, text string")).count() == 1
