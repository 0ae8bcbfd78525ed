"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens without regular expressions: code points are mapped to classes, the classes (with a look
ahead at contractions and at the end of white space) are the symbols of a small automaton, and the state before each
symbol says whether a pre-token starts there. The automaton's transition functions are composed by an associative
doubling scan; outside the stretches that an apostrophe opens every function is constant, so the scan runs over those
stretches only and stops as soon as all composed functions are constant. Distinct pre-tokens of a chunk then go through
cached pair merging, and each token keeps its byte offset. Decoding concatenates token bytes.

The split equals the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Cases: a null text is encoded as the empty text (no tokens); long texts are whole; rows are independent, so ties,
repeated rows and other columns have no influence; an empty table gives an empty table."""
from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.llm.textops import set_batches, span_hash, text_chunks

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_PIECES = 300_000   # pre-tokens in each of a worker's two cache generations

# Symbols: letter, number, other, space, other white space, apostrophe of a contraction with 1 or 2 letters.
L, N, O, SP, WS, Q1, Q2 = range(7)
# States: the symbol classes above, then C1 / C2 (1 / 2 letters of a contraction to come), CE (its last letter), start.
C1, C2, CE, START = 5, 6, 7, 8
_STEP = np.repeat(np.array([L, N, O, SP, WS, C1, C2], np.uint8)[:, None], 9, 1)
_STEP[L, [C2, C1]] = [C1, CE]
_STEP[Q1, [O, SP]] = O
_STEP[Q2, [O, SP]] = O
# Does a pre-token start at the symbol (row) after the state (column)? White space after white space is decided later.
_STARTS = np.ones((7, 9), bool)
_STARTS[L, [L, SP, C1, C2]] = False
_STARTS[N, [N, SP]] = False
_STARTS[O, [O, SP]] = False
_STARTS[Q1, [O, SP]] = False
_STARTS[Q2, [O, SP]] = False
_STARTS[SP, [SP, WS]] = False
_STARTS[WS, [SP, WS]] = False
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, O, np.uint8)
    kind = {"L": L, "N": N}
    for cp in range(0x110000):
        k = kind.get(unicodedata.category(chr(cp))[0])
        if k is not None:
            table[cp] = k
    table[_WHITE] = WS
    table[0x20] = SP
    return table


def pretoken_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the code points where pre-tokens start; ``first`` are the starts of the (non-empty) texts."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    sym = _classes()[cp]
    head = np.zeros(n + 2, bool)
    head[first] = True
    head[n:] = True
    quote = np.flatnonzero(cp == 0x27)
    if len(quote):
        at = np.append(cp, [0, 0, 0])
        a, b = at[quote + 1], at[quote + 2]
        near = ~head[quote + 1]
        one = near & np.isin(a, [ord(x) for x in "stmd"])
        two = near & ~head[np.minimum(quote + 2, n + 1)] & (
            ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        sym[quote[one]] = Q1
        sym[quote[two]] = Q2
    before = np.empty(n, np.uint8)
    before[1:] = _STEP[sym[:-1], START]
    opened = np.flatnonzero(sym >= Q1)
    if len(opened):
        near = (opened[:, None] + np.arange(-1, 4)).ravel()
        near = np.unique(near[(near >= 0) & (near < n)])
        seq = sym[near]
        cut = np.flatnonzero(np.concatenate(([True], np.diff(near) > 1)) | head[near])
        # A stretch starts with its first symbol's state; a text starts in START.
        f = _STEP[seq]
        fixed = np.where(head[near[cut]], START, before[near[cut]])
        f[cut] = f[cut, fixed][:, None]
        step = 1
        while (f != f[:, :1]).any():  # f[i] becomes the composition of the functions of 2, 4, 8 ... symbols up to i
            f[step:] = np.take_along_axis(f[step:], f[:-step], 1)
            step *= 2
        after = f[:, 0]
        inside = near + 1 < n
        before[near[inside] + 1] = after[inside]
    before[first] = START
    starts = _STARTS[sym, before]
    white = (sym == SP) | (sym == WS)
    # The last white space before something else starts a pre-token of its own (or leads the next one).
    starts[:-1] |= white[:-1] & ~white[1:] & ~head[1:n]
    return np.flatnonzero(starts)


@lru_cache(2)
def _ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    table = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        table[v] = k
    return ranks, table


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank (the leftmost of equals) until no pair is in the vocabulary."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i] += parts[i + 1]
        del parts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge_long_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long pre-token, with a heap over linked parts (time n log n)."""
    import heapq
    n = len(piece)
    end = list(range(1, n + 1))
    left, alive = list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        k = left[i]
        if k >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes chunks of texts; keeps two generations of merged pre-tokens, each of bounded size."""

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        self.ranks, self.table = _ranks(path)
        self.new: dict[bytes, bytes] = {}  # pre-token -> its ids in decimal, a space before each
        self.old: dict[bytes, bytes] = {}
        self.limit = limit

    def piece(self, p: bytes) -> bytes:
        hit = self.new.get(p)
        if hit is None:
            hit = self.old.get(p)
            if hit is None:
                ids = (merge_piece if len(p) <= 64 else merge_long_piece)(p, self.ranks)
                hit = b" " + b" ".join([b"%d" % i for i in ids])
                if len(p) > 256:
                    return hit
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[p] = hit
        return hit

    def chunk(self, buf: np.ndarray, offs: np.ndarray):
        """Per text of a chunk: (ids joined by a space as bytes, ids)."""
        raw = buf.tobytes()
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(cp) == len(raw):
            to_byte = np.arange(len(cp) + 1)
        else:
            to_byte = np.zeros(len(cp) + 1, np.int64)
            np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=to_byte[1:])
        held = np.unique(offs[:-1][np.diff(offs) > 0])
        starts = to_byte[pretoken_starts(cp, np.searchsorted(to_byte, held))]
        ends = np.append(starts[1:], len(raw))
        first = np.searchsorted(starts, offs)
        h = span_hash(buf, starts, ends)
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        got = [self.piece(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        back = back.tolist()
        for t in range(len(offs) - 1):
            lo, hi = int(first[t]), int(first[t + 1])
            text = b"".join([got[k] for k in back[lo:hi]])[1:]
            ids = list(map(int, text.split()))
            if b"".join([self.table[i] for i in ids]) != raw[offs[t]:offs[t + 1]]:  # two pre-tokens of one hash: no cache by hash
                text = b"".join([self.piece(raw[a:b]) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)])[1:]
                ids = list(map(int, text.split()))
            yield text, ids


def decode_ids(ids, path: str) -> bytes:
    table = _ranks(path)[1]
    return b"".join([table[i] for i in ids])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows of (doc_id, text) -> doc_id, token_ids array<int>, token_starts array<long> (byte offsets in the text)."""
    path = path or vocabulary_path()

    def run(batches):
        enc = Encoder(path)
        size = np.array([len(x) for x in enc.table], np.int64)
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                ids = [np.array(i, np.int32) for _, i in enc.chunk(buf, offs)]
                starts = [np.cumsum(size[i]) - size[i] for i in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32())),
                                                  pa.array(starts, pa.list_(pa.int64()))], names=["doc_id", "token_ids", "token_starts"])
    set_batches(docs.sparkSession)
    return _rows(docs).mapInArrow(run, "doc_id long, token_ids array<int>, token_starts array<long>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, token_ids) -> doc_id, text_bytes binary. Null ids give empty bytes."""
    path = path or vocabulary_path()

    def run(batches):
        for b in batches:
            data = [decode_ids(x or [], path) for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "text_bytes"])
    set_batches(tokens.sparkSession)
    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text_bytes binary")


def digests(docs: DataFrame, path: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Encode every whole text, decode its ids again and return doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, and the
    columns ``keep`` of ``docs`` behind them.

    One pass and no shuffle: the ids never leave the task."""
    path = path or vocabulary_path()

    def run(batches):
        enc = Encoder(path)
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                rows = []
                for text, ids in enc.chunk(buf, offs):
                    data = decode_ids(ids, path)
                    rows.append((len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(data).hexdigest(), len(data)))
                n, a, d, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a), pa.array(d),
                                                  pa.array(size, pa.int64()), *[b.column(c).slice(lo, hi - lo) for c in keep]],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", *keep])
    set_batches(docs.sparkSession)
    rows = _rows(docs, keep)
    schema = ["doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long", *[f"{c} {t}" for c, t in rows.dtypes if c in keep]]
    return rows.mapInArrow(run, ", ".join(schema))


def _rows(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
