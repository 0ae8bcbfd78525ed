import zlib

import duckdb
import numpy as np
import pyarrow as pa

from augeval.llm import langid, quality
from augeval.llm.queries import QUERIES
from augeval.llm.textops import text_chunks

SF = "/root/testdata/sf0.01"


def table(name):
    return duckdb.execute(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


def test_quality_held_out_accuracy(spark):
    label = {d: q for d, q, _ in table("labels")}
    got = QUERIES["op6_quality_classifier"](spark, SF).collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) >= 0.95


def test_quality_edge_cases(spark, frame):
    docs = frame([(1, None, 1.0), (2, "", 1.0), (3, "good words here", 1.0), (3, "bad### words###", 1.0), (None, "x", 1.0)],
                 "doc_id long, text string, score double")
    model = quality.train(docs, frame([(3, 1), (3, 0), (4, None), (None, 1)], "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and got[0].score == got[1].score and all(0 <= r.score <= 1 for r in got)
    empty = quality.train(docs, frame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(docs, empty).collect()] == [0.5] * 5
    assert quality.score(frame([], "doc_id long, text string"), model).count() == 0


def test_features_do_not_depend_on_the_chunk():
    texts = ["Some words, some words!", "", "ABC|def 12", "é ü"]
    buf, offs = [(b, o) for _, _, b, o in text_chunks(pa.array(texts))][0]
    for module, split in ((quality, quality.features), (langid, None)):
        for i, t in enumerate(texts):
            b, o = [(b, o) for _, _, b, o in text_chunks(pa.array([t]))][0]
            if split:
                whole, at = split(buf, offs)
                assert sorted(split(b, o)[0]) == sorted(whole[at[i]:at[i + 1]])
            else:
                whole, doc = module.subwords(buf, offs)
                assert sorted(module.subwords(b, o)[0]) == sorted(whole[doc == i])


def test_language_held_out_accuracy(spark):
    lang = {d: x for d, _, x, _, _ in table("documents")}
    got = QUERIES["op7_language_id"](spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert np.mean([r.rejected for r in held]) <= 0.1


def test_language_edge_cases(spark, frame):
    schema = "doc_id long, text string, lang string"
    docs = frame([(k, f"the cat and dog {k}" if k % 2 else f"der hund und katze {k}", "en" if k % 2 else "de") for k in range(40)] +
                 [(100, None, None), (101, "", None), (102, "12 !!", "en"), (105, "\u00bd \u00b2", None), (106, "\u2167", None), (103, "é", None), (104, "漢字", None), (None, "the", None)], schema)
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == 48
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (100, 101, 102, 105, 106))
    assert all(got[k].lang_pred != "und" and 0 < got[k].score <= 1 for k in (1, 2, 103, 104, None))
    none = langid.train(frame([], schema))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(frame([], schema), model).count() == 0
