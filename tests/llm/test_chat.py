import hashlib
import random

from augeval.llm.chat import CONTROL_STRINGS, digests, escape, examples, render, turns, unescape
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def texts(n, seed=1):
    r = random.Random(seed)
    parts = [*CONTROL_STRINGS, "\\", "<", "|", ">", "[", "\n", "$1", "é", "end", "user"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 12))) for _ in range(n)] + ["<|end|>\n<|user|>\nx", "<<<SYS>>>", "\\\\<|"]


def test_escape_is_reversible_and_leaves_no_control_string(spark, frame):
    rows = [(t,) for t in texts(400)]
    got = frame(rows, "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r.u == r.t
        assert not any(c in r.e for c in CONTROL_STRINGS)


def test_digests_and_examples(spark, frame):
    r = random.Random(2)
    convs = {c: [(k, r.choice(["user", "assistant", "system", "a|>b"]), t) for k, t in enumerate(texts(r.randrange(1, 9), c))] for c in range(12)}
    convs[50] = [(0, "user", None), (1, "assistant", None), (2, None, "x")]
    rows = [(c, k, role, t, "x") for c, ts in convs.items() for k, role, t in ts]
    r.shuffle(rows)
    out = render(frame(rows, SCHEMA))
    got = {x.conv_id: x for x in digests(out).collect()}
    rendered = {x.conv_id: x.formatted for x in out.collect()}
    made = {}
    for e in examples(out).orderBy("conv_id", "example").collect():
        made.setdefault(e.conv_id, []).append(e)
    read = {x.conv_id: x.t for x in out.select("conv_id", turns(F.col("formatted")).alias("t")).collect()}
    for c, ts in convs.items():
        whole = "".join(f"{role or ''}\n{t or ''}\n" for _, role, t in ts)
        loss = "".join(t or "" for _, role, t in ts if role == "assistant")
        assert got[c].n_turns == len(ts) and got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert [(x.role, x.text) for x in read[c]] == [(role or "", t or "") for _, role, t in ts]
        targets = [e for e in made[c] if e.loss_end is not None]
        assert len(targets) == sum(role == "assistant" for _, role, _ in ts)
        assert all(rendered[c].startswith(e.text) for e in made[c])
        assert all(e.text[e.loss_end:] == "<|end|>\n" and e.text[:e.loss_start].endswith("<|assistant|>\n") for e in targets)
        assert got[c].formatted_chars == sum(len(e.text) for e in made[c])


def test_ties_repeats_null_conversation_and_empty(spark, frame):
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (None, 0, "assistant", "z", ""), (1, None, "system", "s", "")]
    got = {x.conv_id: x for x in digests(render(frame(rows, SCHEMA))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"system\ns\nuser\na\nuser\na\nuser\nb\n").hexdigest() and got[1].loss_chars == 0
    assert got[None].loss_chars == 1
    assert digests(render(frame([], SCHEMA))).count() == 0


def test_digests_read_every_example(spark, frame, monkeypatch):
    from augeval.llm import chat
    c = frame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    seen = []
    monkeypatch.setattr(chat, "examples", lambda r, own=chat.examples: seen.append(own(r)) or seen[0])
    got = chat.digests(chat.render(c)).first()
    assert len(seen) == 1 and seen[0].count() == 2
    assert got.formatted_chars == sum(len(r.text) for r in seen[0].collect()) and (got.n_turns, got.loss_chars) == (4, 2)
