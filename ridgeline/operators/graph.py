"""The graph of links (survey GR1-GR5)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.checkpoints import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least id of its component.

    Alternating stars: every round points larger neighbours at the least id
    around a node, then smaller ones; it ends when a round changes nothing,
    after a logarithmic number of rounds. Loops and repeated edges don't count.
    """
    current = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    w = Window.partitionBy("u")

    def signature(d: DataFrame):
        return d.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()

    while True:
        both = current.selectExpr("a as u", "b as v").unionByName(current.selectExpr("b as u", "a as v"))
        large = both.withColumn("m", F.least(F.col("u"), F.min("v").over(w))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = (
            lower.withColumn("m", F.min("v").over(w))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select(F.col("e.v").alias("a"), F.col("e.u").alias("b"))
            .where("a <> b")
            .distinct()
        )
        nxt = cut(small)
        if signature(nxt) == signature(current):
            nodes = nxt.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return nodes.unionByName(nxt.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        current = nxt


def degrees(links: DataFrame) -> DataFrame:
    """How many links each node has, over (id1, id2)."""
    ends = links.select(F.explode(F.array("id1", "id2")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def length_histogram(links: DataFrame, top_m: float, bins: int, by: list[Column] | None = None) -> DataFrame:
    """Links by length in ``bins`` equal steps up to ``top_m``: bin (from 1), from_m, n."""
    step = top_m / bins
    b = F.least(F.lit(bins), F.floor(F.col("length_m") / step) + 1).cast("int")
    return links.groupBy(*(by or []), b.alias("bin")).agg(F.count("*").alias("n")).withColumn("from_m", (F.col("bin") - 1) * step)


def _convex(points: np.ndarray) -> list[int]:
    """Indices of the convex hull, counter-clockwise (monotone chain)."""
    order = np.lexsort((points[:, 1], points[:, 0]))

    def half(ids) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1:
                a, b = points[out[-2]], points[out[-1]]
                if (b[0] - a[0]) * (points[i][1] - a[1]) - (b[1] - a[1]) * (points[i][0] - a[0]) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out

    lower, upper = half(order), half(order[::-1])
    return lower[:-1] + upper[:-1] if len(order) > 1 else lower


def concave_outline(points: np.ndarray, ratio: float = 2.0, least: float = 0.0) -> np.ndarray:
    """Outline of a point set: the convex hull, dug in where an edge is long against its distance from an inner point.

    An edge is split at the inner point nearest to it if it is longer than ``least``,
    longer than ``ratio`` times that point's distance and than the new edges would
    be, and if no other edge is nearer to the point.
    """
    points = np.unique(points, axis=0)
    hull = _convex(points)
    free = np.ones(len(points), dtype=bool)
    free[hull] = False

    def away(ids: np.ndarray, a: int, b: int) -> np.ndarray:
        p, q = points[a], points[b]
        d = q - p
        t = np.clip(((points[ids] - p) @ d) / max(float(d @ d), 1e-300), 0, 1)
        return np.linalg.norm(points[ids] - (p + t[:, None] * d), axis=1)

    k = 0
    while k < len(hull) and free.any():
        a, b = hull[k], hull[(k + 1) % len(hull)]
        ids = np.flatnonzero(free)
        near = ids[int(away(ids, a, b).argmin())]
        size = float(np.linalg.norm(points[a] - points[b]))
        reach = max(float(np.linalg.norm(points[near] - points[a])), float(np.linalg.norm(points[near] - points[b])))
        own = float(away(np.array([near]), a, b)[0])
        others = min((float(away(np.array([near]), hull[j], hull[(j + 1) % len(hull)])[0]) for j in range(len(hull)) if j != k), default=np.inf)
        if size > max(least, reach, ratio * own) and own <= others:
            hull.insert(k + 1, int(near))
            free[near] = False
        else:
            k += 1
    return points[hull]


def component_hulls(placed: DataFrame, ratio: float = 2.0) -> DataFrame:
    """One row per component of (root, x, y): root, n, and the outline as an array of points."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = concave_outline(rows[["x", "y"]].to_numpy(float), ratio)
        return pd.DataFrame({"root": [rows["root"].iloc[0]], "n": [len(rows)], "outline": [[{"x": float(x), "y": float(y)} for x, y in own]]})

    return placed.groupBy("root").applyInPandas(run, "root long, n long, outline array<struct<x: double, y: double>>")


def least_cut(n: int, edges: np.ndarray) -> int:
    """Edge connectivity of a graph of n nodes: how few edges part it, 0 if it isn't connected or has one node.

    Nodes are scanned by how strongly they hang together with those scanned before. An edge's ends whose
    connection is thereby shown to be at least the least cut found so far are merged (Nagamochi, Ono and Ibaraki);
    every pass merges some, in practice most. Memory grows with the edges, a pass takes edges times the logarithm of nodes.
    """
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b in {(min(a, b), max(a, b)) for a, b in np.asarray(edges).tolist() if a != b}:
        near[a][b] = near[b][a] = 1
    best = math.inf
    while len(near) > 1:
        best = min(best, min(sum(d.values()) for d in near))
        if best == 0:
            return 0
        parent = list(range(len(near)))

        def find(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        weight, done, queue, scanned = [0] * len(near), [False] * len(near), [(0, 0)], 0
        while queue:
            _, v = heapq.heappop(queue)
            if done[v]:
                continue
            done[v] = True
            scanned += 1
            for u, c in near[v].items():
                if not done[u]:
                    weight[u] += c
                    if weight[u] >= best:
                        parent[find(u)] = find(v)
                    heapq.heappush(queue, (-weight[u], u))
        if scanned < len(near):
            return 0
        names = {r: k for k, r in enumerate(sorted({find(v) for v in range(len(near))}))}
        merged: list[dict[int, int]] = [{} for _ in names]
        for v, own in enumerate(near):
            at = names[find(v)]
            for u, c in own.items():
                to = names[find(u)]
                if to != at:
                    merged[at][to] = merged[at].get(to, 0) + c
        near = merged
    return 0 if best == math.inf else int(best)


def edge_connectivity(edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row per component: root, n_nodes, n_edges, and how few edges part it.

    A component is handled by one task, which holds its edges.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows[["a", "b"]].to_numpy())
        e = np.searchsorted(ids, rows[["a", "b"]].to_numpy())
        return pd.DataFrame({"root": [rows["root"].iloc[0]], "n_nodes": [len(ids)], "n_edges": [len(rows)], "connectivity": [least_cut(len(ids), e)]})

    plain = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tagged = plain.join(components.select(F.col("node").alias("a"), "root"), "a")
    return tagged.groupBy("root").applyInPandas(run, "root long, n_nodes long, n_edges long, connectivity long")
