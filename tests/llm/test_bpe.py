import base64
import hashlib
import random

import pyarrow as pa
import pytest
import tiktoken

from augeval.llm.bpe import Encoder, decode, digests, encode, merge_long_piece, merge_piece, vocabulary_path
from augeval.llm.textops import text_chunks


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts(n=4000):
    r = random.Random(2)
    letters = "ab'strevlmd  \n\t1٣é漢!😀 　'"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    return texts + ["", " ", "  ", "\n\n", "I'll can't 're 's's ''s", "x" * 5000, "ab " * 20000, "<|endoftext|>"]


def test_equals_the_library(library):
    texts, enc = some_texts(), Encoder(vocabulary_path(), 500)
    for lo, hi, buf, offs in text_chunks(pa.array(texts), 1 << 12):
        for t, (text, ids) in zip(texts[lo:hi], enc.chunk(buf, offs), strict=True):
            assert ids == library[1].encode_ordinary(t), t
            assert text == " ".join(map(str, ids)).encode()


def test_long_piece_merges_as_the_short_form(library):
    r = random.Random(3)
    for _ in range(200):
        p = bytes(r.choice(b"abcdetion ") for _ in range(r.randrange(1, 90)))
        assert merge_long_piece(p, library[0]) == merge_piece(p, library[0])


def test_round_trip_offsets_and_digests(spark, frame, library):
    texts = [*some_texts(60), None]
    docs = frame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")
    ids = encode(docs)
    rows = {r.doc_id: r for r in ids.collect() if r.doc_id is not None}
    back = {r.doc_id: bytes(r.text_bytes) for r in decode(ids).collect()}
    got = {r.doc_id: r for r in digests(docs).collect()}
    for i, t in enumerate(texts):
        if i % 7:
            want = library[1].encode_ordinary(t or "")
            assert rows[i].token_ids == want and back[i] == (t or "").encode()
            sizes = [len(library[1].decode_single_token_bytes(x)) for x in want]
            assert rows[i].token_starts == [sum(sizes[:k]) for k in range(min(len(want), 50))] + rows[i].token_starts[50:]
            assert got[i].n_tokens == len(want)
            assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert digests(frame([], "doc_id long, text string")).count() == 0
