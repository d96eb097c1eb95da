"""How many pairs of nodes lie within some distances of each other, without making the pairs (survey GR5).

A task holds a chunk of nodes and the nodes around it, both sorted into small squares of a few dozen.
Of two squares that lie wholly within a distance, or wholly beyond it, no pair is looked at; of
those in between each is. Differences, squares and sums of 64-bit floats keep their order when they are rounded, so that the
bounds of two squares say exactly what the test of each of their pairs would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import links as li

#: Nodes of a small square, on average.
_FEW = 32
#: Nodes around that a task takes at once.
_PORTION = 1 << 19
_EVERY = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _least(reached, hi: float) -> float:
    """The least float of (0, hi] for which a test holds that holds from there on."""
    a, b = (int(np.float64(v).view(np.int64)) for v in (0.0, hi))
    while a < b:
        m = (a + b) // 2
        a, b = (a, m) if reached(np.int64(m).view(np.float64)) else (m + 1, b)
    return float(np.int64(a).view(np.float64))


def bin_edges(limit: float, top_m: float, bins: int) -> np.ndarray:
    """For each bin of ``graph.length_histogram`` the greatest square of a length (in tiles) that falls into it or one before, no more than the limit's."""
    most, step = limit * limit, top_m / bins
    place = lambda d2: min(bins, math.floor(np.sqrt(d2) * 1000.0 / step) + 1)
    edge = lambda k: most if place(most) <= k else float(np.nextafter(_least(lambda d2: place(d2) > k, most), 0.0))
    return np.array([edge(k) for k in range(1, bins)] + [most])


def _squares(tx: np.ndarray, ty: np.ndarray, few: int = _FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of some nodes by small squares, where each square of that order begins (and the end), and its bounds (x0, x1, y0, y1)."""
    wide = max(float(np.ptp(tx)), float(np.ptp(ty)), 1e-12)
    m = max(1, int(math.sqrt(len(tx) / few)))
    x, y = (np.minimum(m - 1, (c - c.min()) / wide * m).astype(np.int64) for c in (tx, ty))
    at = y * m + x
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    bounds = np.stack([f.reduceat(c[order], first) for c in (tx, ty) for f in (np.minimum, np.maximum)])
    return order, np.append(first, len(tx)), bounds


def _taken(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def within(own: tuple, other: tuple, edges: np.ndarray) -> np.ndarray:
    """For each of some nodes (idx, tx, ty, active) and each edge, how many others' squared distance is at most that; either is active, and idx differs."""
    out = np.zeros((len(own[0]), len(edges)), np.int64)
    if not len(own[0]) or not len(other[0]):
        return out
    order, first, bounds = _squares(own[1], own[2])
    order_o, first_o, (bx0, bx1, by0, by1) = _squares(other[1], other[2])
    _, ox, oy, oa = (c[order_o] for c in other)
    # Active ones first within their square, so that a range is either all or the active ones.
    rank = np.lexsort((~oa, np.repeat(np.arange(len(first_o) - 1), np.diff(first_o))))
    ox, oy, oa = ox[rank], oy[rank], oa[rank]
    begin, end = first_o[:-1], first_o[1:]
    half = begin + np.add.reduceat(oa.astype(np.int64), begin)
    for k in range(len(first) - 1):
        mine = order[first[k] : first[k + 1]]
        ax0, ax1, ay0, ay1 = bounds[:, k]
        dx, dy = np.maximum(0.0, np.maximum(bx0 - ax1, ax0 - bx1)), np.maximum(0.0, np.maximum(by0 - ay1, ay0 - by1))
        fx, fy = np.maximum(bx1 - ax0, ax1 - bx0), np.maximum(by1 - ay0, ay1 - by0)
        near, far = dx * dx + dy * dy, fx * fx + fy * fy
        reach = np.flatnonzero(near <= edges[-1])
        near, far = near[reach], far[reach]
        for active, stop in ((True, end), (False, half)):
            rows = mine[own[3][mine] == active]
            if not len(rows):
                continue
            x, y = own[1][rows, None], own[2][rows, None]
            some = stop[reach] - begin[reach]
            for e, edge in enumerate(edges):
                out[rows, e] += int(some[far <= edge].sum())
                cut = reach[(near <= edge) & (far > edge)]
                at = _taken(begin[cut], stop[cut])
                step = max(1, (1 << 17) // len(rows))
                for s in range(0, len(at), step):
                    some_at = at[s : s + step]
                    px, py = ox[some_at] - x, oy[some_at] - y
                    px *= px
                    py *= py
                    px += py
                    out[rows, e] += np.count_nonzero(px <= edge, axis=1)
    # A node is no pair with itself.
    by = np.argsort(other[0], kind="stable")
    a, b = (np.searchsorted(other[0][by], own[0], side) for side in ("left", "right"))
    twin, at = np.repeat(np.arange(len(a)), b - a), by[_taken(a, b)]
    dx, dy = other[1][at] - own[1][twin], other[2][at] - own[2][twin]
    d2 = np.where(own[3][twin] | other[3][at], dx * dx + dy * dy, np.inf)
    np.subtract.at(out, twin, (d2[:, None] <= edges).astype(np.int64))
    return out


def _count(edges: np.ndarray, by_node: bool):
    """Rows come by chunk: its nodes, then those around. Counts of each node, or (bin, n) of all."""
    n = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, waiting, total, own = None, [], [], np.zeros(n, np.int64), None
        state: dict = {"counts": None}

        def settle() -> None:
            """Counts what waits; pairs of a chunk's own cell are met from both ends."""
            nonlocal own, waiting
            if not waiting:
                return
            if own is None:
                own = tuple(np.concatenate(c) for c in zip(*parts))
                state["counts"] = np.zeros((len(own[0]), n), np.int64)
            cols, waiting = tuple(np.concatenate(c) for c in zip(*waiting)), []
            take = lambda which: tuple(cols[c][which] for c in (0, 2, 3, 4))
            mine = (own[0], *own[2:5])
            if by_node:
                state["counts"] += within(mine, take(slice(None)), edges)
            else:
                state["counts"] += within(mine, take(cols[5]), edges) + 2 * within(mine, take(~cols[5]), edges)

        def over() -> Iterator[pa.RecordBatch]:
            nonlocal total
            settle()
            if state["counts"] is not None:
                if by_node:
                    some = np.flatnonzero(state["counts"][:, 0])
                    yield pa.RecordBatch.from_arrays([pa.array(own[1][some]), pa.array(state["counts"][some, 0])], names=["node", "degree"])
                else:
                    total = total + state["counts"].sum(axis=0)
            state["counts"] = None

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
            for p, q in zip(edge[:-1], edge[1:]):
                at, kind = tuple(key[p, :3]), key[p, 3]
                if at != now:
                    yield from over()
                    now, parts, own = at, [], None
                rows = tuple(batch.column(k).slice(int(p), int(q - p)).to_numpy(zero_copy_only=False) for k in range(4, 10))
                if kind == 0:
                    parts.append(rows)
                else:
                    waiting.append(rows)
                    if sum(len(w[0]) for w in waiting) >= _PORTION:
                        settle()
        yield from over()
        if not by_node:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, n + 1)), pa.array(np.diff(total, prepend=0))], names=["bin", "twice"])

    return run


def _gathered(nodes: DataFrame, max_length_m: float, around: list[tuple[int, int]]) -> DataFrame:
    placed = li.place_nodes(nodes).select(F.col("idx").cast("long").alias("idx"), F.col("database_line").cast("long").alias("database_line"), "tx", "ty", F.coalesce("active", F.lit(False)).alias("active"))
    placed = placed.where("idx is not null and tx is not null and ty is not null")
    # Nodes around are sent to each chunk, and a chunk is held: both grow with the root of a cell's nodes.
    held, met, _ = li.in_chunks(placed, li.cell_side(max_length_m), lambda n: F.ceil(F.sqrt(n / 8192.0)), around)
    columns = ["cx", "cy", "chunk", "kind", "idx", "database_line", "tx", "ty", "active", "same"]
    own = held.withColumns({"kind": F.lit(0), "same": F.lit(True)}).select(columns)
    key = ["cx", "cy", "chunk"]
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.unionByName(met.withColumn("kind", F.lit(1)).select(columns)).repartition(tasks, *key).sortWithinPartitions(*key, "kind")


def node_degrees(nodes: DataFrame, max_length_m: float) -> DataFrame:
    """``graph.degrees`` of the links of ``links.link_nodes(nodes, max_length_m)``: node, degree."""
    limit = max_length_m / 1000.0
    rows = _gathered(nodes, max_length_m, _EVERY).mapInArrow(_count(np.array([limit * limit]), True), "node long, degree long")
    return rows.groupBy("node").agg(F.sum("degree").alias("degree"))


def link_lengths(nodes: DataFrame, max_length_m: float, bins: int) -> DataFrame:
    """``graph.length_histogram`` of the same links, up to the limit: bin, n, from_m."""
    edges = bin_edges(max_length_m / 1000.0, max_length_m, bins)
    rows = _gathered(nodes, max_length_m, li.AROUND).mapInArrow(_count(edges, False), "bin long, twice long")
    step = max_length_m / bins
    counted = rows.groupBy(F.col("bin").cast("int").alias("bin")).agg((F.sum("twice") / 2).cast("long").alias("n")).where("n > 0")
    return counted.withColumn("from_m", (F.col("bin") - 1) * step)
