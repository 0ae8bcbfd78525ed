"""Connected components of an edge table.

Up to LOCAL_EDGES distinct edges (a fixed bound, checked by a count unless the caller has one) are joined in one task. More edges go through
alternating large-star and small-star steps, DataFrame joins only, until nothing changes.

Every step writes its edges to the shared checkpoint folder, so a lost executor recomputes one step. Hubs are safe:
the minimum of a neighbourhood is a map-side combined aggregate, and the join back to a hub's rows has one row on its
other side, which adaptive skew joins can split."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.session import cut_lineage, drop_tables


LOCAL_EDGES = 500_000


def lowest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), sorted, and the smallest node each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, low[i], m)   # hook the roots as well
        np.minimum.at(new, low[j], m)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _join_all(batches):
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        nodes, low = lowest_labels(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "component"])


def _star(e: DataFrame, large: bool) -> DataFrame:
    if large:
        e = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = e.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("m"))
    j = e.join(lowest, F.col("a") == F.col("k"))
    if large:
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lowest.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES, at_most: int | None = None) -> DataFrame:
    """(a, b) edges of longs -> (node, component): the smallest node reachable, for every node on an edge.

    Edges with a null end and loops are ignored; repeated edges count once; no edges give no rows. ``at_most``: a number of edges,
    repeated ones included, that the caller knows there are no more than; where that is local, nothing is counted or written first."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if at_most is not None and at_most <= local_edges:
        return cut_lineage(e.repartition(1).mapInArrow(_join_all, "node long, component long"), "cc-joined")
    e = cut_lineage(e.distinct(), "cc")
    if e.count() <= local_edges:
        joined = cut_lineage(e.repartition(1).mapInArrow(_join_all, "node long, component long"), "cc-joined")
        drop_tables(e)
        return joined
    sign = None
    while True:
        before, e = e, cut_lineage(_star(_star(e, large=True), large=False), "cc")
        drop_tables(before)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == sign or now["n"] == 0:
            break
        sign = (now["n"], now["h"])
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
