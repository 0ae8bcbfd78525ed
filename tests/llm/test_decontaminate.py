import random
import re

from augeval.llm import decontaminate
from augeval.llm.decontaminate import contamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    wins = {}
    for i, t in bench:
        ws = words(t)
        for p in range(max(len(ws) - 9, 1) if ws else 0):
            wins.setdefault(tuple(ws[p:p + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        ws, hit, items = words(t), set(), set()
        for k in {len(w) for w in wins}:
            for p in range(len(ws) - k + 1):
                if (w := tuple(ws[p:p + k])) in wins:
                    hit |= set(range(p, p + k))
                    items |= wins[w]
        out.append((-1 if i is None else i, len(ws), len(hit), ",".join(sorted(items))))
    return sorted(out)


def case(seed):
    r = random.Random(seed)
    vocab = ["The", "of", "a1", "naïve", "ÉTÉ", "zz", "x-y", "日本", "cat", "dog"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", "\n", ", ", "--"]) for _ in range(n))
    bench = [(i, text(r.choice([9, 10, 11, 25, 60]))) for i in range(40)] + [(i, text(r.choice([4, 5, 6]))) for i in range(40, 46)]
    bench += [(0, bench[0][1]), (99, bench[5][1]), (None, bench[7][1]), (100, None), (101, " ,;"), (102, "")]
    docs = [(i, text(r.randrange(0, 200))) for i in range(60)]
    docs += [(i + 100, text(20) + b + text(20)) for i, (_, b) in enumerate(bench) if b] + [(7, docs[9][1]), (7, bench[3][1]), (7, bench[3][1])]
    docs += [(500, None), (501, ""), (502, " \t"), (None, bench[4][1]), (503, bench[4][1].upper()), (504, (bench[3][1] + " ") * 300)]
    return docs, bench


def result(spark, frame, docs, bench):
    d = frame([(*x, "e", 2) for x in docs], "doc_id long, text string, win string, n int").repartition(3)
    return contamination(d, frame([(*x, 1) for x in bench], "item_id long, text string, k int")).collect()


def test_equal_to_brute_force(spark, frame, monkeypatch):
    docs, bench = case(1)
    rows = result(spark, frame, docs, bench)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in rows)
    assert got == brute(docs, bench) and sum(g[2] > 0 for g in got) > 50 and sum(g[2] == 0 for g in got) > 3
    for r in rows:
        assert len({i for s in r.spans for i in range(s["from"], s["to"])}) == r.n_hit
    # Smaller passes: more scans, the same rows.
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 9000)
    monkeypatch.setattr(decontaminate, "PASS_SHINGLES", 200)
    again = result(spark, frame, docs, bench)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in again) == got


def test_items_shorter_than_a_shingle(spark, frame):
    docs = [(1, "a b c"), (2, "b"), (3, "c a b b"), (4, ""), (5, "cc dd ee")]
    bench = [(1, "B"), (2, "a b"), (3, "dd ee"), (4, "zz yy")]
    got = sorted((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in result(spark, frame, docs, bench))
    assert got == brute(docs, bench)


def test_empty_tables(spark, frame):
    docs, bench = case(2)
    assert result(spark, frame, [], bench) == []
    rows = result(spark, frame, docs, [])
    assert len(rows) == len(docs) and all(r.n_hit == 0 and r["items"] == [] for r in rows)
    rows = result(spark, frame, docs, [(1, None), (2, "--")])
    assert len(rows) == len(docs) and not any(r.n_hit for r in rows)


def test_plan_runs_no_python_and_no_cross_join(spark, frame):
    docs, bench = case(3)
    plan = contamination(frame(docs, "doc_id long, text string"), frame(bench, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))
