"""Embedding near-duplicates with hierarchical navigable small-world graphs per shard.

Vectors of one label (and length) are dealt to shards of bounded size by hash, and each shard gets its graph: levels by a
hash of the id, points inserted level by level in batches, neighbours chosen by the usual diversity rule. Every
shard's vectors then query every shard of their label (each pair of shards once, a link is symmetric): greedy
descent, a beam on the lowest level, and from the links found on through the neighbours that are nearly links. An
audit compares queries of each pair of shards with brute force, without their matches with themselves, and doubles the beam until
the recall is RECALL or more (a beam of an eighth of the shard gives way to brute force): both the mean over AUDIT queries that have a
link, one of a direction, so that a small group counts as much as a large one (all queries are looked through for them where
links are rare), and the share of the pairs of AUDIT queries dealt evenly, so that large groups are whole. Links are verified by cosine in double precision. Shards return
a count of links and a spanning edge per vector, never pairs; the edges are joined to components.

A shard's search runs for all its queries in step, in numpy: every step expands one candidate per query.

Cases: vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link with nothing;
so do vectors of different lengths. A null id keeps its row, with a null component, no links and kept false. Of rows that
repeat an id, the smallest by label and vector stands for all. Equal vectors link like others. An empty table gives no rows."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.llm.graph import connected_components
from augeval.llm.textops import mix, set_batches
from augeval.session import cut_lineage

SHARD = 8192         # vectors in a shard, on average at most
M = 8                # neighbours on upper levels; twice as many on the lowest
BUILD_BEAM = 32
BEAM = 32
AUDIT = 64
AUDIT_STEP = 512
RECALL = 0.98
NEAR = 0.02          # how far under the threshold the search still walks on


def levels(ids: np.ndarray) -> np.ndarray:
    u = (mix(ids.view(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(M)).astype(np.int64), 12)


def _similar(x: np.ndarray, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return np.einsum("ad,amd->am", q, x[nodes], optimize=True)


def select(x: np.ndarray, q: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Choose m of the candidates (sorted by similarity, -1 = none) of each query: those nearer to the query than to a chosen
    one first, then the nearest of the rest."""
    n, c = cand.shape
    order = np.argsort(-sim, 1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    own = x[cand]
    between = np.einsum("acd,aed->ace", own, own, optimize=True)
    good = np.zeros((n, c), bool)
    for k in range(c):
        near = (good & (between[:, k] > sim[:, k, None])).any(1)
        good[:, k] = ~near & (good.sum(1) < m) & (cand[:, k] >= 0)
    rank = np.argsort(~good * 2 + (cand < 0) * 4, 1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, rank, 1)
    if out.shape[1] < m:
        out = np.concatenate([out, np.full((n, m - out.shape[1]), -1)], 1)
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the ef best nodes found for each query; -1 where fewer were met."""
    n, d = len(q), graph.shape[1]
    seen = np.zeros((n, len(x)), bool)
    rows = np.arange(n)
    seen[rows, entry] = True
    ids = np.full((n, ef), -1)
    sim = np.full((n, ef), -np.inf, x.dtype)
    done = np.ones((n, ef), bool)
    ids[:, 0], sim[:, 0], done[:, 0] = entry, np.einsum("ad,ad->a", q, x[entry]), False
    act = rows
    while len(act):
        best = np.where(done[act], -np.inf, sim[act]).argmax(1)
        open_ = ~done[act, best]
        act, best = act[open_], best[open_]
        if not len(act):
            break
        done[act, best] = True
        nb = graph[ids[act, best]]
        new = (nb >= 0) & ~seen[act[:, None], nb]
        r, k = np.nonzero(new)
        seen[act[r], nb[r, k]] = True
        s = np.full((len(act), d), -np.inf, x.dtype)
        s[r, k] = np.einsum("ad,ad->a", q[act[r]], x[nb[r, k]])
        better = s.max(1) > sim[act].min(1)
        a, nb, s = act[better], nb[better], s[better]
        if len(a):
            all_s = np.concatenate([sim[a], s], 1)
            top = np.argpartition(-all_s, ef - 1, 1)[:, :ef]
            sim[a] = np.take_along_axis(all_s, top, 1)
            ids[a] = np.take_along_axis(np.concatenate([ids[a], np.where(np.isfinite(s), nb, -1)], 1), top, 1)
            done[a] = np.take_along_axis(np.concatenate([done[a], ~np.isfinite(s)], 1), top, 1)
    return ids, sim


class Graph:
    """Levels of neighbour tables over the vectors of a shard (unit vectors)."""

    def __init__(self, x: np.ndarray, tables: list[np.ndarray], entry: int):
        self.x, self.tables, self.entry = x, tables, entry

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray) -> Graph:
        n = len(x)
        lev = levels(ids)
        order = np.lexsort((mix(ids.view(np.uint64)), -lev))
        tables = [np.full((n, M * (2 if k == 0 else 1)), -1) for k in range(int(lev.max()) + 1)]
        g = cls(x, tables, int(order[0]))
        at = 1
        while at < n:
            batch = order[at:at + max(1, min(256, at))]
            at += len(batch)
            g.insert(batch, lev[batch])
        return g

    def insert(self, batch: np.ndarray, lev: np.ndarray) -> None:
        entry = np.full(len(batch), self.entry)
        for k in range(len(self.tables) - 1, -1, -1):
            part = lev >= k
            if not part.all():
                rest = ~part
                ids, _ = beam_search(self.x, self.tables[k], self.x[batch[rest]], entry[rest], 1)
                entry[rest] = ids[:, 0]
            if part.any():
                new = batch[part]
                ids, sim = beam_search(self.x, self.tables[k], self.x[new], entry[part], BUILD_BEAM)
                entry[part] = ids[np.arange(len(new)), sim.argmax(1)]
                self.connect(k, new, ids, sim)

    def connect(self, k: int, new: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        table, m = self.tables[k], self.tables[k].shape[1]
        own = self.x[new] @ self.x[new].T  # points of one batch see each other as well
        np.fill_diagonal(own, -np.inf)
        take = min(M, len(new))
        near = np.argpartition(-own, take - 1, 1)[:, :take]
        s = np.take_along_axis(own, near, 1)
        cand = np.concatenate([ids, np.where(np.isfinite(s), new[near], -1)], 1)
        table[new] = select(self.x, self.x[new], cand, np.concatenate([sim, s], 1), m)
        src = np.repeat(new, m)
        dst = table[new].ravel()
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        hub, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(hub), 512):
            h, f, c = hub[lo:lo + 512], first[lo:lo + 512], count[lo:lo + 512]
            wide = int(c.max())
            add = np.full((len(h), wide), -1)
            col = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            add[np.repeat(np.arange(len(h)), c), col] = src[f[0]:f[0] + c.sum()]
            add[(add[:, :, None] == table[h][:, None, :]).any(2)] = -1
            both = np.concatenate([table[h], add], 1)
            s = np.where(both >= 0, _similar(self.x, self.x[h], both), -np.inf)
            if wide > 4 * m:  # a hub met many new points: the diversity rule looks at the nearest
                top = np.argpartition(-s, 4 * m, 1)[:, :4 * m]
                both, s = np.take_along_axis(both, top, 1), np.take_along_axis(s, top, 1)
            table[h] = select(self.x, self.x[h], both, s, m)

    def links(self, q: np.ndarray, ef: int, threshold: float, own: np.ndarray | None = None) -> np.ndarray:
        """Queries x nodes: the links found with a beam of ef and by walking on from them over the lowest level's edges,
        in both directions. ``own``: the queries' own nodes where they are in this graph."""
        n = len(self.x)
        if 8 * ef >= n:  # so wide a beam costs more than all products
            return q.astype(np.float64) @ self.x.astype(np.float64).T >= threshold - 1e-6
        entry = np.full(len(q), self.entry)
        for table in self.tables[:0:-1]:
            ids, _ = beam_search(self.x, table, q, entry, 1)
            entry = ids[:, 0]
        ids, sim = beam_search(self.x, self.tables[0], q, entry, ef)
        found, seen = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        r, k = np.nonzero(sim >= threshold - NEAR)
        node, s = ids[r, k], sim[r, k]
        if own is not None:
            new = np.flatnonzero(~(sim >= threshold).any(1) | ~(ids == own[:, None]).any(1))
            r, node, s = np.append(r, new), np.append(node, own[new]), np.append(s, np.ones(len(new)))
        seen[r, node] = True
        src, col = np.nonzero(self.tables[0] >= 0)
        dst = self.tables[0][src, col]
        edges = np.unique(np.concatenate([src * n + dst, dst * n + src]))
        edge_to = edges % n
        first = np.searchsorted(edges // n, np.arange(n + 1))
        found[r[s >= threshold - 1e-6], node[s >= threshold - 1e-6]] = True
        while len(r):
            next_r, next_node = [], []
            for lo in range(0, len(r), 100_000):
                at = node[lo:lo + 100_000]
                count = first[at + 1] - first[at]
                rr = np.repeat(r[lo:lo + 100_000], count)
                nn = edge_to[np.arange(len(rr)) + np.repeat(first[at] - (np.cumsum(count) - count), count)]
                ok = ~seen[rr, nn]
                pair = np.unique(rr[ok] * n + nn[ok])
                rr, nn = pair // n, pair % n
                seen[rr, nn] = True
                s = np.einsum("ad,ad->a", q[rr], self.x[nn]) if len(rr) else np.zeros(0)
                found[rr[s >= threshold - 1e-6], nn[s >= threshold - 1e-6]] = True
                next_r.append(rr[s >= threshold - NEAR])
                next_node.append(nn[s >= threshold - NEAR])
            r, node = np.concatenate(next_r), np.concatenate(next_node)
        return found


def _truth(g: Graph, q: np.ndarray, part: np.ndarray, threshold: float, own: np.ndarray | None) -> np.ndarray:
    """Queries ``part`` x nodes: the links by brute force, without those of a query with itself."""
    truth = q[part] @ g.x.T >= threshold
    if own is not None:
        truth[np.arange(len(part)), own[part]] = False
    return truth


def directions(g: Graph, q: np.ndarray, threshold: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Up to AUDIT queries that have a link, no two of them linked with each other, and their links."""
    order = np.argsort(mix(np.arange(1, len(q) + 1, dtype=np.uint64)))
    some: list[int] = []
    rows: list[np.ndarray] = []
    for lo in range(0, len(q), AUDIT_STEP):
        part = order[lo:lo + AUDIT_STEP]
        truth = _truth(g, q, part, threshold, own)
        for k in np.flatnonzero(truth.any(1)):
            if some and (q[some] @ q[part[k]] >= threshold).any():
                continue
            some.append(int(part[k]))
            rows.append(truth[k])
            if len(some) == AUDIT:
                return np.array(some), np.array(rows)
    return np.array(some, np.int64), np.array(rows, bool).reshape(len(some), len(g.x))


def audited_links(g: Graph, q: np.ndarray, threshold: float, own: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
    """Links of the queries, the recall of the audit and the beam that reached it."""
    ef = BEAM
    if 8 * ef >= len(g.x):  # all products
        return g.links(q, ef, threshold, own), 1.0, ef
    each, links = directions(g, q, threshold, own)
    even = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64)
    pairs = _truth(g, q, even, threshold, own)
    while True:
        found = g.links(q, ef, threshold, own)
        mean = float(((found[each] & links).sum(1) / links.sum(1)).mean()) if len(each) else 1.0
        recall = min(mean, float((found[even] & pairs).sum() / pairs.sum()) if pairs.any() else 1.0)
        if recall >= RECALL or 8 * ef >= len(g.x):
            return found, recall, ef
        ef *= 2


def _pack_shard(table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids)
    v = table.column("v").combine_chunks()
    x = v.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
    ids = ids[order]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.build(x.astype(np.float32), ids)
    head = [table.column(c).slice(0, 1) for c in ("label", "dim", "shard", "n_shards")]
    return pa.table([*head, pa.array([ids.tobytes()]), pa.array([x.tobytes()]), pa.array([[t.astype(np.int32).tobytes() for t in g.tables]]),
                     pa.array([g.entry], pa.int64())], names=["label", "dim", "shard", "n_shards", "ids", "vectors", "graph", "entry"])


def _query(threshold: float):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                ia, ib = np.frombuffer(r["ids_a"], np.int64), np.frombuffer(r["ids"], np.int64)
                xa, xb = np.frombuffer(r["vectors_a"]).reshape(-1, dim), np.frombuffer(r["vectors"]).reshape(-1, dim)
                g = Graph(xb.astype(np.float32), [np.frombuffer(t, np.int32).reshape(len(xb), -1).astype(np.int64) for t in r["graph"]], r["entry"])
                same = r["shard_a"] == r["shard"]
                found, recall, ef = audited_links(g, xa.astype(np.float32), threshold, np.arange(len(ia)) if same else None)
                if same:
                    found |= found.T
                    np.fill_diagonal(found, False)
                i, j = np.nonzero(found)
                cos = np.concatenate([np.einsum("ad,ad->a", xa[i[k:k + 200_000]], xb[j[k:k + 200_000]]) for k in range(0, len(i), 200_000)] or [np.zeros(0)])
                i, j = i[cos >= threshold], j[cos >= threshold]
                both = np.concatenate([ia, ib]) if not same else ia
                off = 0 if same else len(ia)
                count = np.bincount(i, minlength=len(both)) + (0 if same else np.bincount(j + off, minlength=len(both)))
                low = np.arange(len(both))
                rank = np.argsort(np.argsort(both, kind="stable"), kind="stable")
                low = rank.copy()
                while len(i):
                    before = low.copy()
                    np.minimum.at(low, i, low[j + off])
                    np.minimum.at(low, j + off, low[i])
                    if (low == before).all():
                        break
                linked = np.flatnonzero(count)
                root = np.sort(both, kind="stable")[low[linked]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[linked]), pa.array(count[linked].astype(np.int64)), pa.array(root), pa.array(np.full(len(linked), recall)),
                     pa.array(np.full(len(linked), ef, np.int64))], names=["vec_id", "n", "root", "recall", "beam"])
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard: int = SHARD) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept, one row per row of the input."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    v = cut_lineage(v.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.*"), "hnsw-vectors")
    fine = v.where("label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) "
                   "and exists(v, x -> x <> 0)").withColumn("dim", F.size("v").cast("long"))
    sizes = fine.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("n_shards"))
    dealt = fine.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("n_shards")))
    set_batches(spark)
    shards = dealt.groupBy("label", "dim", "shard", "n_shards").applyInArrow(
        _pack_shard, "label long, dim long, shard long, n_shards long, ids binary, vectors binary, graph array<binary>, entry long")
    shards = cut_lineage(shards, "hnsw-shards")
    pairs = shards.select("label", "dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shard"))).alias("shard_a"))
    left = shards.select("label", "dim", F.col("shard").alias("shard_a"), F.col("ids").alias("ids_a"), F.col("vectors").alias("vectors_a"))
    met = pairs.join(left, ["label", "dim", "shard_a"]).join(shards.drop("n_shards"), ["label", "dim", "shard"])
    n = max(1, pairs.count())
    set_batches(spark, 1)
    found = cut_lineage(met.repartition(min(n, 10_000), "label", "dim", "shard", "shard_a").mapInArrow(
        _query(threshold), "vec_id long, n long, root long, recall double, beam long"), "hnsw-links")
    set_batches(spark)
    count = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    comp = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(count, "vec_id", "left") \
        .join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
