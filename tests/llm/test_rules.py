import re
from collections import Counter

from augeval.llm.rules import POLICIES, ablation, apply_policy, bit, ledger

TEXTS = [None, "", " \n\t", "one two", "ab cd ef gh ij kl mn op qr st uv", "x y z w v " * 8, "line one here\n" * 5 + "other words follow now and then again",
         "THE WORDS ARE ALL IN CAPITALS HERE AND THERE OK", "a| b| c# d e f g h i j k l", "é ü ß ñ words with marks and more of them here ok",
         "word " * 3 + "\x0bw\x0c" + "tail " * 4, "p q r s t u v w x y z " + "long" * 5000]


def measures(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    cover = {j for i in range(len(ws) - 4) if grams[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_measures_and_verdicts(spark, frame):
    rows = ledger(frame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, "one two", 1), (None, "x", 1)], "doc_id long, text string, bits int"))
    got = apply_policy(rows, "v1").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None:
            m = measures(TEXTS[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
            assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
            assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert 4 in kept and 9 in kept and 7 not in kept and 8 not in kept and 6 not in kept
    assert apply_policy(ledger(frame([], "doc_id long, text string")), "v1").count() == 0


def test_ablation_counts_bits(spark, frame):
    rows = ledger(frame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    all_bits = [r.bits for r in rows.collect()]
    for r in ablation(rows, "v1").collect():
        assert r.n_failed == sum(b & bit(r.rule) != 0 for b in all_bits)
        assert r.n_only_this == sum(b == bit(r.rule) for b in all_bits)
    assert {r.rule for r in ablation(rows, "base").collect()} == set(POLICIES["base"])
