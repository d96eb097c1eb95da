"""MinHash near-duplicates verified with odd sketches.

Every text is folded to words and cut into shingles of three words. 255 minima
under independent hash functions sample the shingle set. The samples serve
twice: 51 bands of five samples find candidates, and an odd sketch (a bitmap of
512 bits in which every sample flips one bit) verifies them. The population
count x of the XOR of two sketches estimates how many samples differ, and so
the Jaccard similarity: J = 1 + n / (4 k) * ln(1 - 2 x / n).

Texts of equal words are first collapsed to one representative, so that a text
copied a million times costs one candidate. In every band's bucket all pairs
count: a pair is skipped only if both are already connected, which
changes no group. A bucket of more than ``CHUNK`` texts is cut into chunks. They are
first joined each by itself and, through other buckets, with all else; then texts of
one bucket that are still in different groups meet in pairs of chunks, one task each. Groups are
connected components, found by alternating large-star and small-star rounds over checkpointed edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import chunks_by_size, cut, fold, mix64, read, word_hashes
from ridgeline.operators.graph import connected_components

SHINGLE = 3
ROWS, BANDS = 5, 51
SAMPLES = ROWS * BANDS
BITS = 512
THRESHOLD = 0.6
_CHUNK_BYTES = 1 << 20
#: Texts of one bucket that one task compares with each other.
CHUNK = 8192

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_SALT = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_BAND_MUL = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_INDEX = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def shingle_hashes(folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some non-empty folded texts, and where each text's begin.

    A text of fewer than three words is one shingle.
    """
    words, counts = word_hashes(folded)
    first = np.concatenate(([0], np.cumsum(counts)))
    n = np.maximum(counts - SHINGLE + 1, 1)
    starts = np.concatenate(([0], np.cumsum(n)))[:-1]
    at = np.arange(int(n.sum())) - np.repeat(starts, n) + np.repeat(first[:-1], n)
    end = np.repeat(first[1:], n)
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(SHINGLE):
        inside = at + j < end
        h += np.where(inside, words[np.minimum(at + j, len(words) - 1)], _SALT[j]) * _SALT[SHINGLE + j]
    return mix64(h), starts


def minima(folded: list[str]) -> np.ndarray:
    """One row of samples for each non-empty folded text."""
    h, starts = shingle_hashes(folded)
    h32 = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(folded), SAMPLES), dtype=np.uint32)
    v = np.empty_like(h32)
    for k in range(SAMPLES):
        np.multiply(h32, _A[k], out=v)
        v += _B[k]
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps, as rows of BITS / 64 words of 64 bits."""
    bit = (mix64(m.astype(np.uint64) + _INDEX) % np.uint64(BITS)).astype(np.int64)
    flat = (np.arange(len(m), dtype=np.int64)[:, None] * BITS + bit).ravel()
    parity = (np.bincount(flat, minlength=len(m) * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(m), BITS), axis=1).view(np.uint64)


def band_keys(m: np.ndarray) -> np.ndarray:
    v = m.astype(np.uint64).reshape(len(m), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key + v[:, :, r] * _BAND_MUL[r] + np.uint64(r))
    return key.view(np.int64)


def similarity(x: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from population counts of XORed sketches."""
    inner = np.maximum(1 - 2 * x / BITS, 1e-9)
    return np.clip(1 + BITS / (4 * SAMPLES) * np.log(inner), 0, 1)


#: The largest population count that still means a similarity of at least t.
def most_bits(t: float) -> int:
    return int(np.flatnonzero(similarity(np.arange(BITS // 2 + 1)) >= t).max())


_SKETCH_SCHEMA = "doc_id long, content binary, bands array<long>, sketch binary"
_SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def content_key(folded: str) -> bytes | None:
    """What texts of equal words share; None without words."""
    return xxhash.xxh3_128_digest(folded.encode()) if folded else None


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in chunks_by_size([len(t or "") + 1 for t in texts], _CHUNK_BYTES):
            folded = [fold(t) if t else "" for t in texts[a:b]]
            keys = [content_key(t) for t in folded]
            has = np.array([k is not None for k in keys])
            own, w = [t for t in folded if t], BITS // 8
            m = minima(own) if own else np.zeros((0, SAMPLES), np.uint32)
            offsets = pa.array(np.concatenate(([0], np.cumsum(has * BANDS))), pa.int32(), mask=np.append(~has, False))
            sketches = np.full(len(folded), None, dtype=object)
            raw = odd_sketches(m).tobytes()
            sketches[has] = [raw[k : k + w] for k in range(0, len(raw), w)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(band_keys(m).ravel())), pa.array(sketches.tolist(), pa.binary())], schema=_SKETCH_ARROW
            )


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, content key, band keys and odd sketch of every document row; all null but the id for a row without an id or a word."""
    text = F.when(F.col("doc_id").cast("long").isNotNull(), F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_sketch, _SKETCH_SCHEMA)


def _join_components(a: tuple, b: tuple, limit: int, edges: list[tuple[int, int]]) -> None:
    """Adds an edge wherever a pair of one row of ``a`` and one of ``b`` is similar and not connected yet; each is (ids, sketches, components).

    Components are arrays, relabelled as they grow together.
    """
    ids, sketches, comp = a
    ids_b, sketches_b, comp_b = b
    for i in range(len(ids)):
        other = np.flatnonzero(comp_b != comp[i])
        if not len(other):
            continue
        x = np.bitwise_count(sketches_b[other] ^ sketches[i]).sum(axis=1)
        for j in other[x <= limit]:
            old, new = comp_b[j], comp[i]
            if old != new:
                edges.append((int(ids[i]), int(ids_b[j])))
                comp[comp == old] = new
                comp_b[comp_b == old] = new


def bucket_edges(ids: np.ndarray, sketches: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs of similarity above the limit connect among some texts.

    Each is held against the leaders so far and joins one that it is similar to; those that
    joined one are then held against all that is not connected with them, so no similar pair is lost.
    """
    n = len(ids)
    comp = np.arange(n)
    edges: list[tuple[int, int]] = []
    todo = np.arange(n)
    while len(todo):
        lead, todo = todo[0], todo[1:]
        near = np.bitwise_count(sketches[todo] ^ sketches[lead]).sum(axis=1) <= limit
        edges += [(int(ids[lead]), int(i)) for i in ids[todo[near]]]
        comp[todo[near]] = lead
        todo = todo[~near]
    # Leaders have met all that came after them and joined nobody before: whatever pair is left has one that joined.
    for i in np.flatnonzero(comp != np.arange(n)):
        one = slice(i, i + 1)
        _join_components((ids[one], sketches[one], comp[one]), (ids, sketches, comp), limit, edges)
    return edges


def _unique(edges: list[tuple[int, int]]) -> np.ndarray:
    if not edges:
        return np.zeros((0, 2), np.int64)
    e = np.array(edges, dtype=np.int64)
    return np.unique(np.stack([e.min(axis=1), e.max(axis=1)], axis=1), axis=0)


def _by_key(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """(keys, rest...) arrays of whole groups of rows with equal key (the first column); the last column holds sketches."""
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns - 1)]
        own.append(np.frombuffer(b"".join(batch.column(columns - 1).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64))
        last = int(np.searchsorted(own[0], own[0][-1]))
        if last or (held and held[0][0][0] != own[0][0]):
            parts = [*held, tuple(c[:last] for c in own)]
            yield tuple(np.concatenate(c) for c in zip(*parts))
            held = []
        held.append(tuple(c[last:] for c in own))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _within(limit: int):
    """Edges within each group of (key, node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, sk in _by_key(batches, 3):
            edges: list[tuple[int, int]] = []
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(start, len(keys)))
            two = start[size == 2]
            two = two[np.bitwise_count(sk[two] ^ sk[two + 1]).sum(axis=1) <= limit]
            edges += zip(ids[two].tolist(), ids[two + 1].tolist())
            for s, n in zip(start[size > 2], size[size > 2]):
                edges += bucket_edges(ids[s : s + n], sk[s : s + n], limit)
            e = _unique(edges)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return run


def _across(limit: int):
    """Edges between rows of different roots in each group of (key, side, node, root, sketch): those of side 0 against those of side 1; one side alone against itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, side, ids, roots, sk in _by_key(batches, 5):
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            for s, e in zip(bounds[:-1], bounds[1:]):
                edges: list[tuple[int, int]] = []
                comp, left = roots[s:e].copy(), side[s:e] == 0
                if left.all():
                    for k in range(e - s):
                        one, later = slice(k, k + 1), slice(k + 1, None)
                        _join_components((ids[s:e][one], sk[s:e][one], comp[one]), (ids[s:e][later], sk[s:e][later], comp[later]), limit, edges)
                else:
                    a, b = ((ids[s:e][m], sk[s:e][m], comp[m].copy()) for m in (left, ~left))
                    _join_components(*((a, b) if len(a[0]) <= len(b[0]) else (b, a)), limit, edges)
                found = _unique(edges)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def _across_chunks(hot: DataFrame, roots: DataFrame, sketches: DataFrame, limit: int, chunk: int) -> DataFrame:
    """Edges between texts that share a bucket of more than ``chunk`` texts and are in different groups so far.

    Texts of one group (root) in a bucket fill chunks of their own if there are many, else
    they share chunks with other groups. Chunks meet in pairs, but for those of one group.
    """
    rooted = cut(hot.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")))
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("c"))
    small = F.coalesce(F.sum(F.when(F.col("c") * 2 < chunk, F.col("c"))), F.lit(0))
    split = sizes.groupBy("band").agg(F.count("*").alias("groups"), small.alias("small")).where("groups > 1").select("band", "small")
    big = F.col("c") * 2 >= chunk
    label = F.struct(
        F.when(big, F.col("root")).otherwise(F.lit(-1)).alias("g"),
        F.when(big, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / chunk))).otherwise(F.pmod(F.xxhash64("root"), F.greatest(F.ceil(F.col("small") / chunk), F.lit(1)))).cast("int").alias("k"),
    )
    placed = cut(rooted.join(sizes, ["band", "root"]).join(split, "band").select("band", "node", "root", label.alias("own")))
    labels = placed.groupBy("band", "own").count().groupBy("band").agg(F.collect_list("own").alias("every"))
    meets = F.filter("every", lambda o: (o["g"] == -1) | (o["g"] != F.col("own.g")))
    met = placed.join(labels, "band").select("band", "node", "root", "own", F.explode(meets).alias("other"))
    key = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    rows = met.select(key.alias("key"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "root").join(sketches, "node").select("key", "side", "node", "root", "sketch")
    return rows.repartition("key").sortWithinPartitions("key", "side", "node").mapInArrow(_across(limit), "a long, b long")


def _connect(contents: DataFrame, limit: int, chunk: int) -> DataFrame:
    """(node, root) of every text of (node, bands, sketch) that is similar to another which shares a bucket."""
    own = contents.select("node", "sketch")
    w = Window.partitionBy("band")
    shared = cut(contents.select(F.explode("bands").alias("band"), "node").withColumn("n", F.count("*").over(w)).where("n > 1"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk))
    key = F.when(F.col("n") <= chunk, F.col("band")).otherwise(F.xxhash64("band", part))
    rows = shared.select(key.alias("key"), "node").join(own, "node").select("key", "node", "sketch")
    found = cut(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_within(limit), "a long, b long"))
    roots = connected_components(found)
    hot = shared.where(F.col("n") > chunk).select("band", "node")
    if not hot.isEmpty():
        roots = connected_components(found.unionByName(_across_chunks(hot, roots, own, limit, chunk)))
    return roots


def _groups(docs: DataFrame, threshold: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, one row per document row, and for each distinct (doc_id, content): doc_id, content, kept_doc_id, keep."""
    sketches = cut(sketch_table(docs))
    first = F.min_by(F.struct("doc_id", "bands", "sketch"), "doc_id").alias("r")
    contents = cut(sketches.where("content is not null").groupBy("content").agg(first).select("content", "r.*").withColumn("node", F.monotonically_increasing_id()))
    roots = cut(_connect(contents, most_bits(threshold), chunk))
    named = contents.select("node", "doc_id", "content")
    least = roots.join(named, "node").groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("kept"))
    kept = named.join(roots.join(least, "root").select("node", "kept"), "node", "left").select("content", F.coalesce("kept", F.struct("doc_id", "content")).alias("kept"))
    rows = sketches.select("doc_id", "content").distinct()
    worded = rows.where("content is not null").join(kept, "content").select(
        "doc_id", "content", F.col("kept.doc_id").alias("kept_doc_id"), ((F.col("kept.doc_id") == F.col("doc_id")) & (F.col("kept.content") == F.col("content"))).alias("keep")
    )
    return sketches, worded.unionByName(rows.where("content is null").select("doc_id", "content", F.col("doc_id").alias("kept_doc_id"), F.lit(True).alias("keep")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """One row for each doc_id and text of it: the document kept for its group, and whether it is that one.

    doc_id, kept_doc_id, keep. Texts of equal words are one text. The least doc_id of a
    group stays; rows that repeat a doc_id with other words are grouped each by their own words, and
    of two of them in one group the lesser hash stays. A null or wordless text belongs to no group and stays, once for a doc_id. A null
    doc_id can't be grouped: all such rows give one row with null, null, true. Texts are
    used whole; extra columns are ignored; an empty table gives no row.
    """
    return _groups(docs, threshold, chunk)[1].select("doc_id", "kept_doc_id", "keep")


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """The documents without near duplicates, one row for each that stays, all columns as they were.

    Rows that repeat a doc_id stay or go each by their own words; of those that repeat the words too
    (or have none) one stays, the least hash of the whole row. Rows with a null doc_id stay as they
    are. Texts are used whole; extra columns of any name are kept; of an empty table nothing is left.
    """
    sketches, groups = _groups(docs, threshold, chunk)
    groups = cut(groups)
    again = cut(sketches.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    gone = groups.where("not keep").select(F.col("doc_id").alias("gone"))
    own = docs["doc_id"].cast("long")
    if again.isEmpty():
        return docs.join(gone, own == gone["gone"], "left_anti")
    once = docs.join(again, own == again["again"], "left_anti")
    once = once.join(gone, once["doc_id"].cast("long") == gone["gone"], "left_anti")

    @F.arrow_udf("binary")
    def content(texts: pa.Array) -> pa.Array:
        return pa.array([content_key(fold(t)) if t else None for t in texts.to_pylist()], pa.binary())

    key, nth = _fresh(docs, "content"), _fresh(docs, "nth")
    some = docs.join(again, own == again["again"], "left_semi").withColumn(key, content(F.col("text").cast("string")))
    stay = groups.where("keep").select(F.col("doc_id").alias("stays"), F.col("content").alias("as"))
    some = some.join(stay, (some["doc_id"].cast("long") == stay["stays"]) & some[key].eqNullSafe(stay["as"]), "left_semi")
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    one = some.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(whole))).where(F.col(nth) == 1)
    return once.unionByName(one.drop(key, nth))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
SQL: dict[str, str] = {}
