import re
import zlib
from collections import Counter

import numpy as np

from augeval.llm import spelling
from augeval.llm.spelling import count_words, near_pairs, run_crc, variants, vocabulary


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def test_variants_equal_to_all_pairs(spark, frame):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(150)]
    words = set(base)
    for w in base:
        for _ in range(4):
            i, c = int(rng.integers(0, len(w) + 1)), str(rng.choice(list("abcÿ")))
            words |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]}
    words = sorted(words - {""}) + ["x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "a", "b", "ab"]
    counts = {w: int(5 * 10 ** rng.uniform(0, 5)) for w in words}
    d = frame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert sorted(map(tuple, variants(d).collect()), key=lambda r: r[0]) == want
    # Filters far too small let nearly every edit pass, and lose nothing.
    assert sorted(map(tuple, variants(d, limit=64).collect()), key=lambda r: r[0]) == want
    pairs = near_pairs(vocabulary(d)).collect()
    assert len(pairs) == len({frozenset((r.word, r.other)) for r in pairs})
    assert variants(d.where("n < 0")).count() == 0


def test_chain_of_forms(spark, frame):
    rows = [("aaaaaa", 5 ** 1), ("aaaaab", 5 ** 2), ("aaaabb", 5 ** 3), ("aaabbb", 5 ** 4), ("aabbbb", 5 ** 5), ("abbbbb", 5 ** 6)]
    got = {r.word: r.root for r in variants(frame(rows, "word string, n long")).collect()}
    assert set(got.values()) == {"abbbbb"}


TEXTS = [None, "", "Hello-there hello_there HELLO", "naïve Ünïcode straße ÀÉÎ×÷ñandú œuvre", "one1two2three-fourfive",
         "hello there " * 300 + "Zebra crossing crossings", "x" * 40000 + " " + "ab" * 7, "crossing\ncrossing\tcrossing crossing"]


def typed(rows, every):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                n[w] += 1
    return n


def test_words_and_typos(spark, frame):
    rows = [(i if i % 9 else None, TEXTS[i % len(TEXTS)]) for i in range(120)] + [(5, TEXTS[5])] * 2
    d = frame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, word string")
    for every in (199, 3, 0):
        want = {w: n for w, n in typed(rows, every).items() if n >= 5}
        assert {r.word: r.n for r in count_words(d, typo_every=every).collect()} == want and len(want) > 7
    assert count_words(frame([], "doc_id long, text string")).count() == 0


def test_crc_goes_on_from_the_prefix():
    text = "añb".encode() * 3 + b"zz"
    buf = np.frombuffer(text, np.uint8)
    starts, ends = np.array([0, 2, 5, 5]), np.array([4, 14, 5, 9])
    state = np.array([zlib.crc32(b"7:")] * 4, np.uint32)
    assert run_crc(buf, starts, ends, state).tolist() == [zlib.crc32(b"7:" + text[s:e]) for s, e in zip(starts, ends)]
    assert spelling._CRC[1] == 0x77073096
