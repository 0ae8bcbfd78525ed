"""The pipeline's stages against brute force on the smallest tables, each on its own input."""
import hashlib

import pytest

import corpus_pipeline as cp
from augeval.llm.bpe import vocabulary_path
from augeval.session import load

from .test_bpe import library  # noqa: F401
from .test_jaccard_join import brute as near_groups
from .test_suffix_dedup import brute as passages


@pytest.fixture(scope="module")
def outputs(spark, sf):
    """The input and the result of every stage, as rows."""
    docs, out = load(spark, sf, "documents"), []
    out.append(docs.collect())
    for _, stage in cp.STAGES:
        rows = stage(spark, docs, sf).collect()
        out.append(rows)
        if rows and "text" in rows[0]:
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_classifier_keeps_good_and_drops_bad(spark, sf, outputs):
    label = {r.doc_id: r.quality for r in load(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in outputs[1]}
    good, bad = ({r.doc_id for r in outputs[0] if label.get(r.doc_id) == q} for q in (1, 0))
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.2 * len(bad)
    assert {tuple(r) for r in outputs[1]} <= {tuple(r) for r in outputs[0]}


def test_one_document_of_each_group_stays(outputs):
    groups = near_groups([(r.doc_id, r.text) for r in outputs[1]], cp.NEAR_WORDS, cp.NEAR_NUM, cp.NEAR_DEN)
    assert {r.doc_id for r in outputs[2]} == {low for _, low in groups.values()}


def test_later_passages_are_cut(outputs):
    docs = [(r.doc_id, r.text) for r in outputs[2]]
    cuts = {}
    for i, start, end, _, _, first in passages(docs, 50):
        if not first:
            cuts.setdefault(i, []).append((start, end))
    want = {}
    for i, t in docs:
        at, keep = 0, []
        for a, b in sorted(cuts.get(i, [])):
            keep.append(t[at:a])
            at = max(at, b)
        want[i] = "".join([*keep, t[at:]])
    assert {r.doc_id: r.text for r in outputs[3]} == want
    assert all(r.n_chars == len(r.text) for r in outputs[3])


def test_mixing_keeps_all_rows_and_columns(outputs):
    assert sorted(map(tuple, outputs[4])) == sorted(map(tuple, outputs[3]))
    assert outputs[4][0].__fields__ == cp.COLUMNS


def test_tokens(outputs, library):  # noqa: F811
    text = {r.doc_id: r.text for r in outputs[4]}
    assert vocabulary_path() and len(outputs[5]) == len(text)
    for r in outputs[5]:
        ids = library[1].encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, sf, outputs):
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, outputs[5]))


def test_tokens_follow_the_mixing_schedule(outputs):
    duckdb = pytest.importorskip("duckdb")
    from augeval.llm.queries import ORACLE
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.source) for r in outputs[4]])
    want = {d: (source, block, slot, place) for d, source, block, slot, _, _, place in con.execute(ORACLE["op9_source_mixing"]).fetchall()}
    assert {r.doc_id: (r.source, r.block, r.slot, r.place) for r in outputs[5]} == want
    order = sorted(want, key=lambda d: want[d][2:])
    assert [r.doc_id for r in sorted(outputs[5], key=lambda r: (r.slot, r.place))] == order


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark, frame):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, text["a"]), (2, text["a"] + " end"), (2, text["b"]), (3, text["c"]), (3, text["c"]), (4, text["d"]), (4, text["d"] + " end"),
            (None, text["a"]), (None, text["a"]), (5, ""), (5, "")]
    docs = frame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.keep_one_of_group(spark, docs, None).collect()]
    assert sum(i == 4 for i, _ in got) == 1
    assert sorted(((i or 0, t) for i, t in got if i != 4)) == sorted(
        [(1, text["a"]), (2, text["b"]), (3, text["c"]), (0, text["a"]), (0, text["a"]), (5, ""), (5, "")])
