"""Exact n-gram Jaccard join over a count-vector tree, reduced to link components.

Words are runs of anything but space and 0x09-0x0D, A-Z in lower case; a text's set holds its distinct n-word shingles.
Two texts link when ``den * |intersection| >= num * |union|``. Linked sets of sizes with sum S differ in at most
D = floor(S * (den - num) / (den + num)) shingles.

Method. Shingles are hashed into groups and the group counts are a text's point. The groups are dealt to blocks of 2**20
coordinates; sets of one size class share the dealing, and a set that can have larger partners is entered in the next
class too. A set that may differ from a partner in at most r shingles shares at least two of its first r + 2 block
points with that partner, so a search needs to enter only those nodes of the tree whose bounding box is the query's
own point in a block (an inner node = one block point; a box with room around it prunes nothing here, since the
radius of about 0.1 n in every coordinate exceeds the spread of the counts of unrelated texts). Inside a node:

1. every set is compared with the smallest members of its nodes (one star per node), which joins most copies: first with the
   smallest of all, then with those that are not yet in its component;
2. in nodes that still hold several components, members of different components are compared: nodes of up to SMALL
   sets give their pairs (compared once, and only if they meet in as many nodes as a link must); larger nodes are cut into leaves of
   bounded size, and leaf pairs go down by the bound "sum of coordinate minima of the two boxes", then the same bound
   for two points, and for large sets by points of more coordinates. A pair that meets in several of the MET_NODES first large nodes
   of its sets is compared in the first of them only. A first round takes two sets a component and only as many pairs as would join
   the components, a second one all pairs that are still between components: few, as the bound is close. Of nodes with the same
   members one is read. A set leaves its largest nodes, as many as it shares with a partner less one: the smallest node of a
   linked pair is then still a node of both, and nodes of a common passage lose the sets that have rarer ones.

Every pair passes the bound on its points before its sets are fetched and compared exactly. As the bound of 256 coordinates
lets all pairs of sets of some thousand shingles pass, large sets have a second point with a coordinate for about two shingles. Identical sets are one node
of the graph from the start. Hashes are 64 bits wide: sets are compared by shingle hash, set identity by 64 bits of
its shingles.

Cases: a null or empty text, or one without words, has n_shingles 0 and links with nothing; a null id keeps its row with
a null component; rows that repeat an id stay separate rows, each by its own text; other columns are ignored."""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augeval.llm.graph import connected_components
from augeval.llm.meeting import SCHEMA, met, pack
from augeval.llm.textops import mix, segment_sum, set_batches, shingle_sets, text_chunks
from augeval.session import cut_lineage, drop_tables

COORDS = 1 << 20      # coordinates of one block (few, and blocks of one or two shingles would meet by chance)
BOUND_COORDS = 256    # coordinates of the point that the minima bound uses
FINE_COORDS = 1 << 16 # most coordinates of the point that a pair of large sets is judged by before the sets move
SET_ROWS = 100        # rows with two whole sets, or with leaves, in an Arrow batch
LEAF = 2048           # sets in a leaf, on average: points move once for every leaf of their node
SMALL = 16            # sets in a node whose pairs are listed
BLOCK_PAIRS = 1 << 16 # pairs of a leaf looked at together
MET_NODES = 4         # large nodes of a set that its rows in later nodes name
CLASS_RATIO = 1.6     # sizes within a class
BUCKET_BYTES = 8 << 20
BROADCAST_BYTES = 8 << 20 # keys of pairs sent to every executor
SAMPLE_DOCS = 8000        # texts that tell common shingles from rare ones
COMMON_SHINGLES = 200_000


def size_edges(top: int) -> np.ndarray:
    """First sizes of the classes, up to a class that holds ``top``."""
    e = [1]
    while e[-1] <= top:
        e.append(max(e[-1] + 1, int(e[-1] * CLASS_RATIO)))
    return np.array(e, np.int64)


def _distance(total: np.ndarray, num: int, den: int) -> np.ndarray:
    return total * (den - num) // (den + num)


def _spare(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks beyond the largest difference, on each side of the count, and how many of them a text leaves out."""
    spare = 1 + most // 6
    return spare, np.maximum(1, spare // 2)


def shared_nodes(n: int, num: int, den: int) -> int:
    """Least number of nodes that a set of n shingles shares with a linked set of its size or more."""
    edges = size_edges(n + 1)
    last = int(edges[np.searchsorted(edges, n, "right")]) - 1
    spare, out = _spare(np.array([_distance(2 * last, num, den)]))
    return int(2 * (spare[0] - out[0]) + 1)


def block_points(h: np.ndarray, bounds: np.ndarray, num: int, den: int, common: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of every block point that the texts of a chunk enter in the tree.

    A text that differs from a partner in at most r shingles looks at its first r + 2 s + 1 blocks (s by class) and
    leaves out d <= s of them: at least 2 s + 1 are equal, each side leaves out d, so 2 (s - d) + 1 stay. It leaves out the blocks whose
    rarest shingle is the most common (``common``: sorted hashes and their counts), then those with the fewest shingles."""
    n = np.diff(bounds)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = size_edges(int(n.max()) * den // num + 1)
    cls = np.searchsorted(edges, n, "right") - 1
    top = n * den // num  # largest size of a partner
    frequency = np.zeros(len(h), np.int32)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        frequency = np.where(common[0][at] == h, common[1][at], 0).astype(np.int32)
    out_s, out_d = [], []
    for up in (0, 1):
        c = cls + up
        last = edges[np.minimum(c + 1, len(edges) - 1)] - 1
        r = _distance(n + np.minimum(top, last), num, den)
        most = _distance(2 * last, num, den)
        spare, out = _spare(most)
        m = most + 2 * spare + 1
        use = (n > 0) & (r > 0) & ((top >= edges[np.minimum(c, len(edges) - 1)]) if up else True)
        rows = np.flatnonzero(np.repeat(use, n))
        if not len(rows):
            continue
        d = np.repeat(np.arange(len(n)), n)[rows]
        x = mix(h[rows] ^ (c[d].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        block = ((x & np.uint64(0xFFFFFFFFFF)) % m[d].astype(np.uint64)).astype(np.int64)
        look = r + 2 * spare + 1
        keep = block < look[d]
        d, block, x = d[keep], block[keep], x[keep]
        width = int(look[use].max())
        cell = d * width + block
        order = np.argsort(cell, kind="stable")
        cell, val = cell[order], mix(((x[order] >> np.uint64(40)) & np.uint64(COORDS - 1)) + np.uint64(0xC2B2AE3D27D4EB4F))
        count = frequency[rows][keep][order]
        at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        point = np.add.reduceat(val, at)
        size = np.diff(np.append(at, len(cell)))
        rarest = np.minimum.reduceat(count, at)
        cell = cell[at]
        dd = cell // width
        filled = np.bincount(dd, minlength=len(n))
        drop = np.maximum(out - (look - filled), 0)
        by_size = np.lexsort((size, -rarest, dd))
        rank = np.empty(len(dd), np.int64)
        rank[by_size] = np.arange(len(dd)) - np.searchsorted(dd, dd[by_size])
        stay = rank >= drop[dd]
        cell, point = cell[stay], point[stay]
        for t in np.flatnonzero(use & (look - filled > out)):  # more empty blocks than may be left out: enter those too
            have = cell[(cell >= t * width) & (cell < (t + 1) * width)] - t * width
            miss = np.setdiff1d(np.arange(look[t]), have)[out[t]:]
            cell = np.concatenate([cell, t * width + miss])
            point = np.concatenate([point, np.zeros(len(miss), np.uint64)])
        dd = cell // width
        tag = (c[dd].astype(np.uint64) << np.uint64(40)) + (cell % width).astype(np.uint64)
        out_s.append(mix(point + mix(tag + np.uint64(0x165667B19E3779F9))))
        out_d.append(dd)
    if not out_s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_d)


def _set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds).astype(np.uint64)
    key = mix(segment_sum(mix(h + np.uint64(0x27D4EB2F165667C5)), bounds) + n * np.uint64(0x85EBCA77C2B2AE63))
    return key.view(np.int64)


def _keys(words: int):
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                h, bounds = shingle_sets(buf, offs, words)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(_set_keys(h, bounds))],
                    names=["doc_id", "n_shingles", "set_key"])
    return run


def with_set_key(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with the set_key of ``link_components`` for each row's text."""
    names = docs.columns

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                keys = pa.array(_set_keys(*shingle_sets(buf, offs, words)))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in names], keys], names=[*names, "set_key"])
    set_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("set_key", T.LongType())]))


def _sampled(words: int):
    """Shingles of sampled texts, counted within the chunk before they are shuffled."""
    def run(batches):
        for b in batches:
            for _, _, buf, offs in text_chunks(b.column("text")):
                h, n = np.unique(shingle_sets(buf, offs, words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
    return run


def common_shingles(docs: DataFrame, words: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met in 3 or more texts of a bounded sample (SAMPLE_DOCS texts, COMMON_SHINGLES shingles). They only
    say which blocks a text had better leave out: they change the work, never the result."""
    step = max(1, n_docs // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    rows = some.mapInArrow(_sampled(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3") \
        .orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy()[order]


def _entries(words: int, num: int, den: int, buckets: int, common):
    def run(batches):
        for b in batches:
            for _, _, buf, offs in text_chunks(b.column("text")):
                h, bounds = shingle_sets(buf, offs, words)
                sig, d = block_points(h, bounds, num, den, common.value)
                rows = pack(sig, _set_keys(h, bounds)[d], buckets)
                if rows is not None:
                    yield rows
    return run


def _sets(words: int):
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                h, bounds = shingle_sets(buf, offs, words)
                arr = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
                own = pa.array(_set_keys(h, bounds))
                counts = _counts([h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
                point = [slim_point(c) for c in counts]
                fine = [fine_point(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                part = pa.RecordBatch.from_arrays([own, arr, *[pa.array(p, pa.binary()) for p in (point, fine, map(leaf_point, fine))]],
                                                  names=["key", "shingles", "point", "fine", "leaf_point"])
                yield part.filter(pc.equal(own, b.column("key").slice(lo, hi - lo)))
    return run


def pack_point(counts: np.ndarray) -> bytes | None:
    """A point in one byte a coordinate, in two where a count needs them, null beyond that."""
    top = counts.max()
    return counts.astype(np.uint8 if top < 256 else np.uint16).tobytes() if top < 65536 else None


def slim_point(counts: np.ndarray) -> bytes | None:
    """A point in half a byte a coordinate, as ``pack_point`` where a count needs more."""
    return (counts[::2] * 16 + counts[1::2]).astype(np.uint8).tobytes() if counts.max() < 16 else pack_point(counts)


def unpack_point(point: bytes) -> np.ndarray:
    if len(point) < BOUND_COORDS:
        two = np.frombuffer(point, np.uint8)
        return np.stack([two >> 4, two & 15], 1).ravel()
    return np.frombuffer(point, np.uint8 if len(point) == BOUND_COORDS else np.uint16)


def fine_point(h: np.ndarray) -> bytes | None:
    """The counts of a large set over so many coordinates (a power of two) that each holds about two shingles; null for small
    sets, which their point tells apart, and where a count needs more than a byte."""
    if len(h) <= 2 * BOUND_COORDS:
        return None
    coords = min(FINE_COORDS, 1 << (len(h) // 2 - 1).bit_length())
    counts = _coord_counts(h, coords)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def leaf_point(fine: bytes | None) -> bytes | None:
    """A fine point over a quarter of its coordinates, which goes into the leaves; null where that is no more than a point has."""
    if fine is None or len(fine) < 8 * BOUND_COORDS:
        return None
    counts = _fold(np.frombuffer(fine, np.uint8), len(fine) // 4)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _fold(point: np.ndarray, coords: int) -> np.ndarray:
    """A point over fewer coordinates: both numbers are powers of two, and a coordinate is the low bits of a hash."""
    return point if len(point) == coords else point.reshape(-1, coords).sum(0, dtype=np.int64)


def _within_bound(num: int, den: int, unpack=unpack_point):
    """Keep the pairs whose points allow a link (a set without a point always stays)."""
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True):
                if x is None or y is None:
                    keep.append(True)
                    continue
                x, y = unpack(x), unpack(y)
                x, y = _fold(x, min(len(x), len(y))), _fold(y, min(len(x), len(y)))
                o, total = int(np.minimum(x, y).sum(dtype=np.int64)), int(x.sum(dtype=np.int64) + y.sum(dtype=np.int64))
                keep.append(den * o >= num * (total - o))
            idx = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("a").take(idx), b.column("b").take(idx)], names=["a", "b"])
    return run


def _pairs(num: int, den: int):
    """Pairs of different components in lists of members (by key, with the number of nodes that hold just these) whose sizes allow a
    link, with the small nodes that a link would share, did it share no large node in which both have stayed."""
    def run(batches):
        least = lru_cache(100_000)(lambda n: shared_nodes(n, num, den))
        for b in batches:
            out: dict[tuple[int, int], list[int]] = {}
            for members, nodes in zip(b.column("members").to_pylist(), b.column("nodes").to_pylist(), strict=True):
                m = [(x["key"], x["comp"], x["n"], x["large"], x["left"]) for x in members]
                for i, (k, c, n, large, left) in enumerate(m):
                    for j, d, o, its, gone in m[:i]:
                        if c != d and den * min(n, o) >= num * max(n, o):
                            out.setdefault((k, j), [0, least(min(n, o)) - min(large, its, max(left, gone))])[0] += nodes
            cols = [[k for k, _ in out], [j for _, j in out], [v[0] for v in out.values()], [v[1] for v in out.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "met", "least"])
    return run


def _links(num: int, den: int):
    """Verify candidate pairs: exact sizes of intersections of sorted hash arrays."""
    def run(batches):
        for b in batches:
            sides = []
            for c in ("sa", "sb"):
                col = b.column(c)
                sides.append((col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()))
            (va, oa), (vb, ob) = sides
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
                total = len(x) + len(y)
                if min(len(x), len(y)) * den < num * max(len(x), len(y)):
                    continue
                inter = total - len(np.unique(np.concatenate([x, y])))
                keep[i] = den * inter >= num * (total - inter)
            idx = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("a").take(idx), b.column("b").take(idx)], names=["a", "b"])
    return run


def _coord_counts(s: np.ndarray, coords: int) -> np.ndarray:
    return np.bincount((s.view(np.uint64) >> np.uint64(8)).astype(np.int64) & (coords - 1), minlength=coords)


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BOUND_COORDS), np.int32)
    for i, s in enumerate(sets):
        out[i] = _coord_counts(s, BOUND_COORDS)
    return out


def _leaf_pairs(num: int, den: int, spanning: bool):
    """Rows of one or two leaves of a node -> pairs of different components whose points allow a link."""
    def run(batches):
        for b in batches:
            out = []
            for leaves in b.column("leaves").to_pylist():
                sides = [x["members"] for x in leaves]
                if len({m["comp"] for s in sides for m in s}) > 1:
                    members = [[(m["key"], m["comp"], m["point"]) for m in s] for s in sides]
                    fine, before = ([[m[c] for m in s] for s in sides] for c in ("leaf_point", "before"))
                    out += join_leaves(members[0], members[-1], num, den, spanning, (fine[0], fine[-1]), (before[0], before[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())],
                                             names=["a", "b"])
    return run


def join_leaves(left, right, num: int, den: int, spanning: bool, fine=None, before=None) -> list[tuple[int, int]]:
    """Pairs between two leaves of (key, component, point): components differ and the points allow a link. ``spanning``:
    only as many as would join the components if all of them were links. ``fine``: points of large sets (else null) of both
    sides, in place of their points. ``before``: nodes of both sides' sets; pairs with a node in common are compared there."""
    fine = [[None if p is None else np.frombuffer(p, np.uint8) for p in side] for side in fine or [[None] * len(left), [None] * len(right)]]

    def point(p, f):
        if f is not None:
            return _fold(f, BOUND_COORDS)
        return unpack_point(p) if p is not None else np.full(BOUND_COORDS, 65535)

    ca, cb = (np.array([point(m[2], f) for m, f in zip(side, of, strict=True)], np.uint16) for side, of in zip((left, right), fine, strict=True))
    open_a, open_b = (np.array([m[2] is None and f is None for m, f in zip(side, of, strict=True)]) for side, of in zip((left, right), fine, strict=True))
    na, nb = ca.sum(1, dtype=np.int64), cb.sum(1, dtype=np.int64)
    reach = lambda o, x, y: den * o >= num * (x + y - o)
    box = int(np.minimum(ca.max(0), cb.max(0)).sum(dtype=np.int64))
    if not (open_a.any() or open_b.any() or reach(box, int(na.min()), int(nb.min()))):
        return []
    width = np.uint16 if min(na.max(), nb.max()) < 65536 else np.int64
    comps = np.unique([m[1] for m in [*left, *right]], return_inverse=True)[1]
    comp_a, comp_b = comps[:len(left)], comps[len(left):]
    keys_a, keys_b = (np.array([m[0] for m in side]) for side in (left, right))
    there: dict[int, list[int]] = {}
    for j, nodes in enumerate(before[1] if before else []):
        for x in nodes:
            there.setdefault(x, []).append(j)
    there = {x: np.array(at) for x, at in there.items()}
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    step = max(1, BLOCK_PAIRS // len(right))
    for lo in range(0, len(left), step):
        a = np.arange(lo, min(lo + step, len(left)))[:, None]
        todo = reach(np.minimum(na[a], nb), na[a], nb) | open_b | open_a[a]
        todo &= (comp_a[a] != comp_b) & (keys_a[a] != keys_b)
        if left is right:
            todo &= np.arange(len(right)) < a
        for i, nodes in enumerate(before[0][lo:lo + step] if before else []):
            for x in nodes:
                if x in there:
                    todo[i, there[x]] = False
        i, j = np.nonzero(todo)
        i += lo
        o = np.zeros(len(i), np.int64)
        for at in range(0, len(i), BLOCK_PAIRS // 8):
            some = slice(at, at + BLOCK_PAIRS // 8)
            o[some] = np.minimum(ca[i[some]], cb[j[some]]).sum(1, dtype=width)
        near = reach(o, na[i], nb[j]) | open_b[j] | open_a[i]
        for i, j in zip(i[near].tolist(), j[near].tolist(), strict=True):
            (key, comp, _), (other, its, _) = left[i], right[j]
            if spanning and find(its) == find(comp):
                continue
            x, y = fine[0][i], fine[1][j]
            if x is not None and y is not None:
                coords = min(len(x), len(y))
                if not reach(int(np.minimum(_fold(x, coords), _fold(y, coords)).sum(dtype=np.int64)), na[i], nb[j]):
                    continue
            if spanning:
                parent[find(its)] = find(comp)
            out.append((max(key, other), min(key, other)))
    return out


def _fetched(pairs: DataFrame, held: DataFrame, column: str, to: str, few: bool) -> DataFrame:
    """Pairs (a, b) with a column of both sets, as ``to``a and ``to``b."""
    side = lambda k: held.select(F.col("key").alias(k), F.col(column).alias(to + k))
    if few:  # pairs go to the sets: only the sets of a pair move, once a pair and once a partner
        left = side("a").join(F.broadcast(pairs), "a")
        right = side("b").join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    else:
        left, right = pairs.join(side("a"), "a"), side("b")
    return left.join(right, "b")


def _verified(pairs: DataFrame, held: DataFrame, num: int, den: int) -> tuple[DataFrame, int]:
    """Pairs (a, b) of set keys that link, written: first by their points, then by the fine points of large sets, then by their sets.
    With them a number that they are no more than: of the pairs whose points allow a link."""
    few = lambda n: n * 16 <= BROADCAST_BYTES
    side = lambda k: held.select(F.col("key").alias(k), F.col("point").alias("p" + k))
    near = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_within_bound(num, den), "a long, b long"), "jaccard-within")
    n = near.count()
    if not n:
        return near, 0
    fine = cut_lineage(_fetched(near, held, "fine", "p", few(n)).mapInArrow(
        _within_bound(num, den, lambda p: np.frombuffer(p, np.uint8)), "a long, b long"), "jaccard-fine")
    drop_tables(near)
    links = cut_lineage(_fetched(fine, held, "shingles", "s", few(n) or few(fine.count())).mapInArrow(
        _links(num, den), "a long, b long"), "jaccard-links")
    drop_tables(fine)
    return links, n


def _mixed(member: DataFrame, components: DataFrame) -> DataFrame:
    """Members (sig, key) of the nodes that hold several components, with comp and the node's size. Near copies meet in dozens of nodes:
    of the nodes with the same members one stays, with their number (``nodes``)."""
    m = member.join(components, F.col("key") == F.col("node"), "left").select("sig", "key", F.coalesce("component", "key").alias("comp"))
    nodes = m.groupBy("sig").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                 F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    nodes = nodes.where("lo <> hi").groupBy("size", "x", "y").agg(F.min("sig").alias("sig"), F.count("*").alias("nodes"))
    return m.join(nodes.select("sig", "size", "nodes"), "sig")


def _least(n: Column, top: int, num: int, den: int) -> Column:
    """``shared_nodes`` of up to ``top`` shingles."""
    edges = size_edges(top + 1).tolist()
    out = F.when(n < edges[1], shared_nodes(edges[0], num, den))
    for lo, hi in zip(edges[1:], edges[2:], strict=False):
        out = out.when(n < hi, shared_nodes(lo, num, den))
    return out


def _left_largest(member: DataFrame, sizes: DataFrame, top: int, num: int, den: int) -> DataFrame:
    """Members with n, without the rows in the largest large nodes of a set: with a linked set it shares ``least`` nodes at the least, so
    of the nodes in the order of (size, sig) it leaves as many at the end as count less than that. The first node that a pair shares stays a
    node of both, and what a pair shares of left nodes is left by one of the two. ``large``: large nodes of the set; ``left``: those left."""
    by_key = Window.partitionBy("key")
    end = by_key.orderBy(F.desc("size"), F.desc("sig")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = _least(F.ceil(F.col("n") * num / den), top, num, den)  # of the smallest set that it links with
    goes = (F.col("size") > SMALL) & (F.col("upto") < least)
    weight = lambda which: F.coalesce(F.sum(F.when(which, F.col("nodes"))).over(by_key), F.lit(0))
    return member.join(sizes, "key").withColumn("upto", F.sum("nodes").over(end)).withColumn("goes", goes) \
        .withColumn("large", weight(F.col("size") > SMALL)).withColumn("left", weight(F.col("goes"))).where("not goes").drop("upto", "goes")


def _leaf_rows(member: DataFrame, held: DataFrame) -> DataFrame:
    """Large nodes as leaves of bounded size, every two leaves of a node in a row of their own. Nodes of one leaf
    are read where their members meet. A row names the first MET_NODES nodes of its set that come before its own (``before``)."""
    sets = member.groupBy("key").agg(F.min("comp").alias("comp"), F.sort_array(F.collect_list(F.struct("sig", "size"))).alias("nodes"))
    points = held.select("key", F.when(F.col("leaf_point").isNull(), F.col("point")).alias("point"), "leaf_point")
    leaves = sets.join(points, "key").withColumn("first", F.slice("nodes.sig", 1, MET_NODES)).withColumn("node", F.explode("nodes")) \
        .select("key", "comp", "point", "leaf_point", F.col("node.sig").alias("sig"), F.ceil(F.col("node.size") / LEAF).cast("int").alias("n_leaves"),
                F.filter("first", lambda x: x < F.col("node.sig")).alias("before")) \
        .withColumn("leaf", F.pmod(F.xxhash64("key"), F.col("n_leaves")).cast("int")) \
        .groupBy("sig", "n_leaves", "leaf").agg(F.collect_list(F.struct("key", "comp", "point", "leaf_point", "before")).alias("members"))
    one = leaves.where("n_leaves = 1").select(F.array(F.struct("leaf", "members")).alias("leaves"))
    met_leaves = leaves.where("n_leaves > 1").select("sig", F.explode(F.sequence(F.lit(0), F.col("n_leaves") - 1)).alias("other"), "leaf", "members") \
        .select("sig", F.least("leaf", "other").alias("i"), F.greatest("leaf", "other").alias("j"), "leaf", "members") \
        .groupBy("sig", "i", "j").agg(F.collect_list(F.struct("leaf", "members")).alias("leaves")).select("leaves")
    return one.union(met_leaves)


def _leaf_join(member: DataFrame, held: DataFrame, num: int, den: int, spanning: bool) -> DataFrame:
    """Candidate pairs (a, b) of large nodes."""
    return _leaf_rows(member, held).mapInArrow(_leaf_pairs(num, den, spanning), "a long, b long").distinct()


def _ends(member: DataFrame) -> DataFrame:
    """Two members of each component of a node (those of the smallest and the largest key), with the size that the node has then."""
    two = member.groupBy("sig", "comp").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    size = two.groupBy("sig").agg((F.count("*") + F.count_if(F.col("lo") < F.col("hi"))).alias("size"))
    return two.join(size, "sig").select("sig", "size", "comp", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key"))


def link_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, set_key, component_id, group_key (one a component, where ids repeat
    as well)."""
    if den > CLASS_RATIO * num:
        raise ValueError("the similarity must be at least 1 / CLASS_RATIO")
    spark = docs.sparkSession
    set_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = cut_lineage(d.mapInArrow(_keys(words), "doc_id long, n_shingles long, set_key long"), "jaccard-keys")
    n_docs, total, top = keyed.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0)), F.coalesce(F.max("n_shingles"), F.lit(0))).first()
    common = spark.sparkContext.broadcast(common_shingles(d, words, n_docs))
    buckets = int(max(24, total * (den - num) / num * 2 * 16 // BUCKET_BYTES))
    entries = d.mapInArrow(_entries(words, num, den, buckets, common), SCHEMA)
    nodes = cut_lineage(met(entries), "jaccard-nodes")
    rep = keyed.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("set_key").alias("key")).agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    wanted = nodes.select("key").union(nodes.select(F.col("lead").alias("key"))).distinct().join(rep.select("key", "rep"), "key")
    held = wanted.join(d, F.col("rep") == F.col("doc_id")).select("key", "text")
    held = held.mapInArrow(_sets(words), "key long, shingles array<long>, point binary, fine binary, leaf_point binary")
    if not keyed.groupBy("doc_id", "set_key").count().where("count > 1").isEmpty():  # rows that repeat an id with its text
        held = held.dropDuplicates(["key"])
    held = cut_lineage(held, "jaccard-sets")

    pairs = cut_lineage(nodes.where("key <> lead").select(F.greatest("key", "lead").alias("a"), F.least("key", "lead").alias("b"))
                        .distinct(), "jaccard-pairs")
    set_batches(spark, SET_ROWS)
    # A long text has many leaders: its pair with the smallest one first, then those that are still between components.
    first, n_first = _verified(pairs.groupBy("a").agg(F.min("b").alias("b")), held, num, den)
    joined = connected_components(first, at_most=n_first)
    of = lambda k: joined.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    others, n_others = _verified(rest, held, num, den)
    star, n_star = first.union(others), n_first + n_others
    hop = connected_components(star, at_most=n_star) if n_others else joined
    drop_tables(pairs)
    member = nodes.select("sig", "key").union(nodes.select("sig", F.col("lead").alias("key"))).distinct()
    member = cut_lineage(_left_largest(_mixed(member, hop), rep.select("key", "n"), top, num, den), "jaccard-members")
    drop_tables(nodes)
    # A linked pair that meets in no large node shares at least ``least`` small ones; the others meet in the leaves below.
    small = member.where(F.col("size") <= SMALL).groupBy("sig").agg(
        F.sort_array(F.collect_list(F.struct("key", "comp", "n", "large", "left"))).alias("members"), F.max("nodes").alias("nodes"))
    near = small.select("members", "nodes").mapInArrow(_pairs(num, den), "a long, b long, met long, least long").groupBy("a", "b").agg(
        F.sum("met").alias("met"), F.max("least").alias("least")).where("met >= least").select("a", "b")
    large = member.where(F.col("size") > SMALL).select("sig", "key", "comp", "size", "nodes")
    any_large = not large.isEmpty()
    ends = []
    if any_large:
        # Pairs of two members a component that would join all components; where one of them is no link, all pairs that the points allow.
        ends = [cut_lineage(_leaf_join(_ends(large), held, num, den, True), "jaccard-ends")]
        near = near.union(ends[0]).distinct()
    set_batches(spark, SET_ROWS)
    listed, n_listed = _verified(near, held, num, den)
    drop_tables(*ends)
    links, n_links = star.union(listed), n_star + n_listed
    groups = connected_components(links, at_most=n_links) if n_listed else hop
    if any_large:
        large = cut_lineage(_mixed(large.select("sig", "key"), groups), "jaccard-large")
        near = cut_lineage(_leaf_join(large, held, num, den, False), "jaccard-near")
        drop_tables(large)
        set_batches(spark, SET_ROWS)
        deep, n_deep = _verified(near, held, num, den)
        if n_deep:
            groups = connected_components(links.union(deep), at_most=n_links + n_deep)
        drop_tables(near, deep)
    drop_tables(member, held, first, others, listed)

    by_key = rep.join(groups, F.col("key") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("component", "key").alias("comp"))
    by_key = by_key.join(by_key.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select(
        F.col("key").alias("set_key"), "component_id", F.col("comp").alias("group_key"))
    out = keyed.join(by_key, "set_key", "left").select(
        "doc_id", "n_shingles", "set_key",
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(
            F.col("doc_id"))).alias("component_id"), "group_key")
    return out
