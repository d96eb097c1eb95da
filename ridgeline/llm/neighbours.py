"""Approximate nearest neighbours with a forest of random-projection trees.

Every tree has its own orthonormal random directions and splits the vectors at the
median of one direction a level. A query has one priority queue for all trees: it
holds the branches not yet followed, ordered by the squared distance from the query
to them within the tree's directions, and leaves are visited in that order, over
all trees together. Members of the leaves visited are ranked by their exact similarity.

How many leaves a query visits is measured, not guessed: ``CALIBRATION`` of the
queries are held against all rows, and the number of leaves is the least that
finds ``TARGET_RECALL`` of their neighbours. The forest serves where that takes at most ``MAX_COMPARED``
comparisons a query, or one in ``INDEX_SHARE`` of all rows if that is more (leaves are medians of a sample, so their sizes
vary a little). Vectors with structure need a few hundred or thousand;
vectors without any, such as uniform noise in 64 dimensions, need a large share of all rows
from any index. Where the forest doesn't reach the target within that bound, it is not searched at all: every query is held
against every row (``search_all``), and the result is exact.

Splits are fitted on a bounded sample (``SAMPLE_ROWS`` for the upper levels, about
``ROWS_A_LEAF`` vectors for each leaf below), every row is indexed. Workers hold the
splits: trees * leaves floats, at most ``MAX_SPLIT_BYTES``; beyond it leaves grow and fewer are visited.
Rows travel once for each tree, to the block of leaves they belong to; a query travels
once to each block that it visits, not to each leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import cut, read

K = 10
TREES, LEAF = 4, 32
TARGET_RECALL, CALIBRATION = 0.92, 256
MAX_COMPARED, INDEX_SHARE = 32_768, 32
MIN_PROBES = 8
MAX_SPLIT_BYTES = 64 << 20
SAMPLE_ROWS, ROWS_A_LEAF = 100_000, 48
#: Leaves that lie side by side in a tree are one block, of about so many vectors: what a task holds at once.
BLOCK_ROWS = 16_384
#: The same for the exact search, where every query travels to every block, so that blocks are as large as a task may hold.
HELD_BYTES = 64 << 20
#: How many of a block's rows the exact search compares with queries at a time.
TILE = 8192
SEED = 20240611


def directions(trees: int, depth: int, dims: int, seed: int = SEED) -> np.ndarray:
    """For each tree one direction a level; as far as the dimensions go, those of a tree are orthonormal."""
    rng = np.random.default_rng(seed)
    out = np.empty((trees, max(depth, 1), dims), dtype=np.float32)
    for t in range(trees):
        for level in range(0, max(depth, 1), dims):
            q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
            out[t, level : level + dims] = q.T[: max(depth, 1) - level]
    return out


def median_splits(projected: np.ndarray, depth: int) -> list[np.ndarray]:
    """Splits of each level from rows' projections on each level's direction."""
    code, splits = np.zeros(len(projected), dtype=np.int64), []
    for level in range(depth):
        order = np.lexsort((projected[:, level], code))
        bounds = np.searchsorted(code[order], np.arange((1 << level) + 1))
        middle = (bounds[:-1] + bounds[1:]) // 2
        level_splits = np.zeros(1 << level, dtype=np.float32)
        some = bounds[1:] > bounds[:-1]
        level_splits[some] = projected[order[middle[some]], level]
        code = code * 2 + (projected[:, level] >= level_splits[code])
        splits.append(level_splits)
    return splits


def route(projected: np.ndarray, splits: list[np.ndarray], depth: int) -> np.ndarray:
    """The node at ``depth`` of one tree in which each row lies."""
    code = np.zeros(len(projected), dtype=np.int64)
    for level in range(depth):
        code = code * 2 + (projected[:, level] >= splits[level][code])
    return code


def visit(projected: np.ndarray, splits: list[list[np.ndarray]], depth: int, probes: int) -> np.ndarray:
    """(tree << 40 | leaf) of the leaves each query visits, nearest first, from its projections (query, tree, level).

    The queue of open branches is kept for all trees together and for many queries at
    once. A branch's near side is as near as the branch itself, so what isn't
    among the ``probes`` nearest branches of a level has no leaf among the ``probes`` nearest.
    """
    n, trees = projected.shape[:2]
    row = np.arange(n)[:, None]
    tree = np.broadcast_to(np.arange(trees), (n, trees))
    node, far = np.zeros((n, trees), np.int64), np.zeros((n, trees), np.float32)
    for level in range(depth):
        margin = projected[row, tree, level] - np.stack([s[level] for s in splits])[tree, node]
        near = node * 2 + (margin >= 0)
        tree, node, far = np.hstack([tree, tree]), np.hstack([near, near ^ 1]), np.hstack([far, far + margin * margin])
        if far.shape[1] > probes:
            own = np.argpartition(far, probes - 1, axis=1)[:, :probes]
            tree, node, far = (np.take_along_axis(a, own, axis=1) for a in (tree, node, far))
    key = (tree.astype(np.int64) << 40) | node
    return np.take_along_axis(key, np.argsort(far, axis=1, kind="stable")[:, :probes], axis=1)


def _unit(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4") + np.float32(0)
            good = np.isfinite(x).all(axis=1)
            raw, w = x[good].tobytes(), 4 * dims
            yield pa.RecordBatch.from_arrays([pa.array(ids[good], pa.int64()), pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())], names=["vec_id", "unit"])

    return run


def _floats(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f4").reshape(-1, width)


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best entries; of entries that tie at the last place those of the least ids."""
    n = min(k, sims.shape[1])
    top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    last = np.take_along_axis(sims, top, axis=1).min(axis=1)
    for i in np.flatnonzero(((sims >= last[:, None]).sum(axis=1) > n) & np.isfinite(last)):
        tied = np.flatnonzero(sims[i] >= last[i])
        top[i] = tied[np.lexsort((ids[tied], -sims[i, tied]))[:n]]
    ok = np.isfinite(np.take_along_axis(sims, top, axis=1))
    return np.nonzero(ok)[0], top[ok]


def _nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, similarity) of the k rows of y most like each row of x, greatest first; of ties those of the least ids.

    ``y`` is taken ``tile`` rows at a time, and what is less than k others of its row is dropped at once. In the first tile these are
    k groups' maxima, later the k best so far.
    """
    row, column, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, x.dtype)
    floor = np.full(len(x), -np.inf, dtype=x.dtype)
    for at in range(0, len(y), tile):
        own = x @ y[at : at + tile].T
        groups = own.shape[1] // 64
        if not at and groups > k:
            floor = np.partition(own[:, : groups * 64].reshape(len(own), 64, groups).max(axis=1), groups - k, axis=1)[:, groups - k]
        hits = np.flatnonzero(own >= floor[:, None])
        r, c = np.divmod(hits, own.shape[1])
        row, column, sims = np.concatenate((row, r)), np.concatenate((column, c + at)), np.concatenate((sims, own.ravel()[hits]))
        if len(row) > 4 * k * len(x) or at + tile >= len(y):
            order = np.lexsort((ids[column], -sims, row))
            row, column, sims = row[order], column[order], sims[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            floor[row[nth == k - 1]] = sims[nth == k - 1]
            row, column, sims = row[nth < k], column[nth < k], sims[nth < k]
    return row, column, sims


def _against_all(sample: np.ndarray, dims: int, k: int):
    """Best k rows of a partition for each of a few vectors, the vectors themselves left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        own_ids, x = sample
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
            sims = x @ _floats(raw, dims).T
            sims[own_ids[:, None] == ids[None, :]] = -np.inf
            q, m = _top(sims, ids, k)
            new = (q, ids[m], raw[m], sims[q, m])
            held = new if held is None else tuple(np.concatenate(c) for c in zip(held, new))
            order = np.lexsort((held[1], -held[3], held[0]))
            nth = np.arange(len(order)) - np.searchsorted(held[0][order], held[0][order])
            held = tuple(c[order[nth < k]] for c in held)
        if held is not None:
            q, m, raw, s = held
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(m), pa.array(raw.tolist(), pa.binary()), pa.array(s.astype(np.float64))], names=["q", "m", "unit", "s"])

    return run


class Forest:
    """Directions and splits, and how many leaves a query visits."""

    def __init__(self, plan: np.ndarray, splits: list[list[np.ndarray]], depth: int, probes: int = 0):
        self.plan, self.splits, self.depth, self.probes = plan, splits, depth, probes

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tld->ntl", x, self.plan, optimize=True)

    def leaves(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """One row for each vector: its node in each tree."""
        p, depth = self.project(x), self.depth if depth is None else depth
        return np.stack([route(p[:, t], self.splits[t], depth) for t in range(len(self.splits))], axis=1)


def grow(unit: DataFrame, n: int, dims: int, trees: int, leaf: int, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> Forest:
    """A forest fitted on a bounded sample of (vec_id, unit)."""
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / leaf)), int(math.log2(MAX_SPLIT_BYTES / 4 / trees))))
    trees = trees if depth else 1
    forest = Forest(directions(trees, depth, dims, seed), [[] for _ in range(trees)], depth)
    if not depth:
        return forest
    chosen = unit.select("vec_id", "unit").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("unit")
    x = _floats([r.unit for r in chosen.collect()], dims)
    top = max(0, min(depth, int(math.log2(max(1, min(n, sample_rows) / ROWS_A_LEAF))))) if n > sample_rows else depth
    for t in range(trees):
        forest.splits[t] = median_splits(x @ forest.plan[t, :top].T, top)
    if top == depth:
        return forest
    # Below, each node of level `top` is split by itself, from about ROWS_A_LEAF vectors for each of its leaves.
    share = min(1.0, ROWS_A_LEAF * (1 << depth) / n)
    part = unit.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    shared = unit.sparkSession.sparkContext.broadcast((forest.plan, forest.splits))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, upper = shared.value
        for batch in batches:
            x = _floats(batch.column(1).to_pylist(), dims)
            for t in range(trees):
                p = np.ascontiguousarray(x @ plan[t].T, dtype="<f4")
                raw, w = p[:, top:].tobytes(), 4 * (depth - top)
                below = [raw[i : i + w] for i in range(0, len(raw), w)]
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pa.array(route(p, upper[t], top)), pa.array(below, pa.binary())], names=["tree", "cell", "p"])

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        levels = median_splits(_floats(rows["p"], depth - top), depth - top)
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "cell": rows["cell"].iloc[:1], "splits": [np.concatenate(levels).astype("<f4").tobytes()]})

    grown = part.select("vec_id", "unit").mapInArrow(project, "tree int, cell long, p binary").groupBy("tree", "cell").applyInPandas(split, "tree int, cell long, splits binary")
    for t in range(trees):
        forest.splits[t] += [np.zeros(1 << level, dtype=np.float32) for level in range(top, depth)]
    for r in grown.collect():
        values, at = np.frombuffer(r.splits, dtype="<f4"), 0
        for level in range(depth - top):
            forest.splits[r.tree][top + level][(r.cell << level) : ((r.cell + 1) << level)] = values[at : at + (1 << level)]
            at += 1 << level
    return forest


def calibrate(unit: DataFrame, asked: DataFrame, forest: Forest, n: int, dims: int, k: int, target: float = TARGET_RECALL, max_compared: int = MAX_COMPARED) -> float:
    """Sets the number of leaves that a query visits, and returns the recall it has on the queries held against all rows.

    A recall below ``target`` says that ``max_compared`` comparisons are too few for it.
    """
    every = len(forest.splits) << forest.depth
    most = min(every, max(MIN_PROBES, max_compared * (1 << forest.depth) // max(n, 1)))
    forest.probes = min(most, MIN_PROBES)
    rows = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).select("vec_id", "unit").collect()
    if not rows:
        return 1.0
    x = _floats([r.unit for r in rows], dims)
    own = unit.select("vec_id", "unit").mapInArrow(_against_all((np.array([r.vec_id for r in rows]), x), dims, k), "q int, m long, unit binary, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "m")
    true = own.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("q", "unit").collect()
    if not true:
        return 1.0
    leaves = forest.leaves(_floats([r.unit for r in true], dims)) | (np.arange(len(forest.splits)) << 40)
    first = np.full(len(true), most)
    asks, step = np.array([r.q for r in true]), max(1, 2_000_000 // most)
    for at in range(0, len(x), step):
        seen = visit(forest.project(x[at : at + step]), forest.splits, forest.depth, most)
        for i in np.flatnonzero((asks >= at) & (asks < at + step)):
            hit = np.flatnonzero(np.isin(seen[asks[i] - at], leaves[i]))
            first[i] = hit[0] if len(hit) else most
    wanted = int(np.sort(first)[math.ceil(target * len(first)) - 1]) + 1
    forest.probes = min(most, max(MIN_PROBES, wanted))
    return float((first < forest.probes).mean())


_KINDS = "key long, asks boolean, leaf long, id long, leaves binary, unit binary"
_FOUND = "q long, m long, similarity double, compared long"


def _rank(best, dims: int, columns: float = math.inf):
    """Applies ``best``, which holds a similarity for each query and up to ``columns`` members, to each block's members and some queries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by block, members before queries: a block's members are held, queries stream past them.
        now, parts, own = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for a, b in zip(edges[:-1], edges[1:]):
                if key[a] != now:
                    now, parts, own = key[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append((part.column(2).to_numpy(zero_copy_only=False).astype(np.int64), part.column(3).to_numpy(), _floats(part.column(5).to_pylist(), dims)))
                    continue
                if own is None and parts:
                    own = tuple(np.concatenate(c) for c in zip(*parts))
                    parts = []
                if own is None:
                    continue
                step = max(1, min(256, int(8_000_000 // min(columns, len(own[1])))))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    yield best(own, some.column(3).to_numpy(), some.column(4).to_pylist(), _floats(some.column(5).to_pylist(), dims))

    return run


def search(unit: DataFrame, asked: DataFrame, forest: Forest, n: int, dims: int, k: int) -> DataFrame:
    """q, m, similarity, compared: the best k of each block that a query visits, and with how many vectors it was compared there."""
    depth, trees = forest.depth, len(forest.splits)
    below = max(0, depth - math.ceil(math.log2(max(1, n / BLOCK_ROWS))))
    shared = unit.sparkSession.sparkContext.broadcast(forest)
    names = ["key", "asks", "leaf", "id", "leaves", "unit"]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.leaves(_floats(batch.column(1).to_pylist(), dims))
                no = pa.array([False] * len(codes)), pa.nulls(len(codes), pa.binary())
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array((t << 40) | (codes[:, t] >> below)), no[0], pa.array(codes[:, t]), batch.column(0), no[1], batch.column(1)], names=names)

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        step = max(1, min(512, 4_000_000 // forest.probes))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                seen = visit(forest.project(_floats(part.column(1).to_pylist(), dims)), forest.splits, depth, forest.probes)
                leaf = seen & ((1 << 40) - 1)
                key = (seen >> 40 << 40) | (leaf >> below)
                row = np.repeat(np.arange(len(seen)), seen.shape[1])
                order = np.lexsort((key.ravel(), row))
                row, key, leaf = row[order], key.ravel()[order], leaf.ravel()[order].astype("<i8")
                edge = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]))))
                ends, raw = np.append(edge[1:], len(row)), leaf.tobytes()
                who = pa.array(row[edge])
                leaves = pa.array([raw[8 * a : 8 * b] for a, b in zip(edge, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[edge]), pa.array([True] * len(edge)), pa.nulls(len(edge), pa.int64()), part.column(0).take(who), leaves, part.column(1).take(who)], names=names)

    def best(own: tuple, ids: np.ndarray, leaves: list[bytes], x: np.ndarray) -> pa.RecordBatch:
        leaf, member, y = own
        sims = np.full((len(ids), len(member)), -np.inf, dtype=np.float32)
        flat = np.frombuffer(b"".join(leaves), dtype="<i8")
        row = np.repeat(np.arange(len(ids)), [len(b) // 8 for b in leaves])
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        edges = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1], [True])))
        starts, stops = np.searchsorted(leaf, flat[edges[:-1]]), np.searchsorted(leaf, flat[edges[:-1]], side="right")
        compared = np.zeros(len(ids), dtype=np.int64)
        for a, b, start, stop in zip(edges[:-1], edges[1:], starts, stops):
            if stop > start:
                sims[row[a:b], start:stop] = x[row[a:b]] @ y[start:stop].T
                compared[row[a:b]] += stop - start
        q, m = _top(sims, member, k)
        first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[q]), pa.array(member[m]), pa.array(sims[q, m].astype(np.float64)), pa.array(np.where(first, compared[q], 0))], names=["q", "m", "similarity", "compared"]
        )

    both = unit.select("vec_id", "unit").mapInArrow(members, _KINDS).unionByName(asked.select("vec_id", "unit").mapInArrow(queries, _KINDS))
    return both.repartition("key").sortWithinPartitions("key", "asks", "leaf", "id").mapInArrow(_rank(best, dims), _FOUND)


def search_all(unit: DataFrame, asked: DataFrame, n: int, dims: int, k: int) -> DataFrame:
    """As ``search``, without an index: every query is held against every row, in blocks of rows that each are one task."""
    blocks = max(1, math.ceil((4 * dims + 16) * n / HELD_BYTES), min(unit.sparkSession.sparkContext.defaultParallelism, math.ceil(n / BLOCK_ROWS)))

    def best(own: tuple, ids: np.ndarray, leaves: list[None], x: np.ndarray) -> pa.RecordBatch:
        _, member, y = own
        q, m, sims = _nearest(x, y, member, k)
        compared = np.where(np.concatenate(([True], q[1:] != q[:-1])), len(member), 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(member[m]), pa.array(sims.astype(np.float64)), pa.array(compared)], names=["q", "m", "similarity", "compared"])

    def rows(own: DataFrame, key: Column, asks: bool) -> DataFrame:
        return own.select(key.alias("key"), F.lit(asks).alias("asks"), F.lit(0).cast("long").alias("leaf"), F.col("vec_id").alias("id"), F.lit(None).cast("binary").alias("leaves"), "unit")

    members = rows(unit, F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(blocks).cast("long")), False)
    queries = rows(asked, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), True)
    return members.unionByName(queries).repartitionById(blocks, F.col("key").cast("int")).sortWithinPartitions("key", "asks").mapInArrow(_rank(best, dims, TILE), _FOUND)


def _prepared(vectors: DataFrame) -> tuple[DataFrame | None, int]:
    """(vec_id, unit) of each vec_id with a vector, and the number of dimensions."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    sizes = own.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None or sizes.d == 0:
        return None, 0
    own = own.where(F.size("embedding") == sizes.d)
    unit = own.mapInArrow(_unit(sizes.d), "vec_id long, unit binary")
    if own.groupBy("vec_id").count().where("count > 1").isEmpty():
        return unit, sizes.d
    return cut(unit.groupBy("vec_id").agg(F.min("unit").alias("unit"))), sizes.d


def nearest_neighbours(
    vectors: DataFrame, asked: Column | None = None, k: int = K, trees: int = TREES, leaf: int = LEAF, target: float = TARGET_RECALL, max_compared: int = MAX_COMPARED, seed: int = SEED
) -> DataFrame:
    """One row per query and neighbour: vec_id, neighbour_id, rank, similarity (cosine).

    Queries are the vectors for whose vec_id the condition ``asked`` holds (all without one),
    held against all vectors; a vector is not its own neighbour. Vectors that are
    null, of zero or infinite length, with a null or NaN in them, or of another
    number of dimensions than most (of equally many: the least) are left out, as are
    rows without vec_id. Of rows that repeat a vec_id the least vector counts. Ties
    in similarity go to the lesser neighbour_id. The index is searched where it finds ``target`` of the neighbours in at most ``max_compared``
    comparisons a query (or one in ``INDEX_SHARE`` of all rows); else all rows are. Equal vectors are searched for once, and a
    group of any size stands in the index once. Extra columns are ignored, whatever their
    names; an empty table or a single vector gives no row.
    """
    spark = vectors.sparkSession
    out = "vec_id long, neighbour_id long, rank int, similarity double"
    base, dims = _prepared(vectors)
    if base is None:
        return spark.createDataFrame([], out)
    base = base.withColumn("content", F.unhex(F.md5("unit")))
    ask = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    copied = cut(base.groupBy("content").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("content", "rep"))
    if copied.isEmpty():
        rows, unit, copies = base.withColumn("rep", F.col("vec_id")), base, None
    else:
        rows = cut(base.join(copied, "content", "left").withColumn("rep", F.coalesce("rep", "vec_id")))
        unit = rows.where("rep = vec_id")
        # A query's k neighbours and itself: more than k + 1 of equal vectors are never needed.
        w = Window.partitionBy("rep").orderBy("vec_id")
        again = rows.join(copied.select("content"), "content", "left_semi").select("rep", "vec_id").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)
        copies = again.groupBy("rep").agg(F.collect_list("vec_id").alias("ids")).withColumnRenamed("rep", "m")
    wanted = rows.where(ask).select("vec_id", "rep")
    if copies is None:
        asking = unit.where(ask)
    else:
        asking = unit.join(wanted.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi")
    n = unit.count()
    forest = grow(unit, n, dims, trees, leaf, seed=seed)
    if calibrate(unit, asking, forest, n, dims, k, target, max(max_compared, n // INDEX_SHARE)) >= target:
        compared = search(unit, asking, forest, n, dims, k + 1)
    else:
        compared = search_all(unit, asking, n, dims, k + 1)
    found = compared.repartition("q").groupBy("q", "m").agg(F.max("similarity").alias("s"))
    near = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), F.col("m").alias("id")))), 1, k + 1).alias("near"))
    if copies is not None:
        pairs = near.select("q", F.explode("near").alias("e")).select("q", F.col("e.d").alias("d"), F.col("e.id").alias("m"))
        pairs = pairs.join(copies, "m", "left").select("q", "d", F.explode(F.coalesce("ids", F.array("m"))).alias("id"))
        near = pairs.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("near"))
        near = wanted.join(near, wanted["rep"] == near["q"]).select("vec_id", "near")
    else:
        near = near.withColumnRenamed("q", "vec_id")
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("vec_id")), 1, k)
    return near.select("vec_id", F.posexplode(others).alias("i", "e")).select("vec_id", F.col("e.id").alias("neighbour_id"), (F.col("i") + 1).alias("rank"), F.round(-F.col("e.d"), 6).alias("similarity"))


#: The registered query set: every vector whose id is divisible by this, against all vectors.
QUERY_IDS = 20


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_IDS == 0)


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
SQL: dict[str, str] = {}
