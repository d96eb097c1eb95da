"""Training order: token ids in fixed-stride shards, in the order of a keyed permutation.

Texts become token ids, each document's ids (with an end mark) are cut into
sequences of at most ``length``, and every sequence of the corpus gets a number.
A Feistel network over the numbers, walked along its cycle until the value falls
below their count, is a permutation of exactly 0 .. N-1: the sequence's slot. A
slot's shard and byte offset follow from it by division, so a reader can go on
from any slot without an index.

Tokens are written once, to a table in the shared folder in which every row
carries the number of the task that made it and its place there; both stay what
they are however the table is read again. One shuffle, by shard, then brings the
sequences of each shard together.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.checkpoints import scratch
from ridgeline.llm.common import mix64, read
from ridgeline.llm.tokens import VOCABULARY, encode, encoding, end_mark

LENGTH = 1024
RECORDS = 8192
KEY = 0x5EED0FACE
ROUNDS = 6
#: doc_id, piece, number of tokens; then ``length`` ids of 16 bits (32 for a vocabulary that needs them), the rest filled with the end mark.
HEADER = "<qii"
HEADER_BYTES = struct.calcsize(HEADER)


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of some sequence numbers below n."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for r in range(ROUNDS):
            f = mix64(right + np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64)))
            left, right = right, left ^ (f & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def id_bytes(vocabulary: str = VOCABULARY) -> int:
    return 2 if end_mark(vocabulary) < 1 << 16 else 4


def stride(length: int = LENGTH, vocabulary: str = VOCABULARY) -> int:
    return HEADER_BYTES + id_bytes(vocabulary) * length


def _cut_into(length: int, vocabulary: str):
    kinds = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoding(vocabulary), TaskContext.get().partitionId(), 0
        end, width = end_mark(vocabulary), id_bytes(vocabulary)
        for batch in batches:
            ids, pieces, tokens = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = encode(enc, text) if text else []
                if not own:
                    continue
                raw = np.array([*own, end], dtype=f"<u{width}").tobytes()
                for k in range(0, len(raw), width * length):
                    ids.append(doc_id)
                    pieces.append(k // (width * length))
                    tokens.append(raw[k : k + width * length])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int64()), pa.array(range(at, at + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(tokens, pa.binary())],
                schema=kinds,
            )
            at += len(ids)

    return run


def sequences(docs: DataFrame, length: int = LENGTH, key: int = KEY, vocabulary: str = VOCABULARY) -> tuple[DataFrame, int]:
    """How many sequences there are, and one row for each: slot, doc_id, piece, tokens (little-endian ids of ``id_bytes`` bytes, without filling)."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own.mapInArrow(_cut_into(length, vocabulary), "part long, at long, doc_id long, piece int, tokens binary").write.option("compression", "zstd").parquet(folder)
    table = spark.read.parquet(folder)
    sizes = table.groupBy("part").count().orderBy("part").collect()
    total, rows = 0, []
    for r in sizes:
        rows.append((r["part"], total))
        total += r["count"]
    if not total:
        return spark.createDataFrame([], "slot long, doc_id long, piece int, tokens binary"), 0
    before = spark.createDataFrame(rows, "part long, before long")

    @F.arrow_udf("long")
    def slot(index: pa.Array) -> pa.Array:
        return pa.array(permute(index.to_numpy(), total, key), pa.int64())

    return table.join(before, "part").select(slot(F.col("before") + F.col("at")).alias("slot"), "doc_id", "piece", "tokens"), total


def _records(length: int, per_shard: int, vocabulary: str):
    width, size = id_bytes(vocabulary), stride(length, vocabulary)
    fill = np.full(length, end_mark(vocabulary), dtype=f"<u{width}").tobytes()
    kinds = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int64()), ("stride", pa.int32()), ("payload", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard_row(shard: int, first: int, parts: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array([shard]), pa.array([first]), pa.array([len(parts)]), pa.array([size], pa.int32()), pa.array([b"".join(parts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=kinds.names)

        shard, first, parts = None, 0, []
        for batch in batches:
            for slot, doc_id, piece, tokens in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if slot // per_shard != shard:
                    if parts:
                        yield shard_row(shard, first, parts)
                    shard, first, parts = slot // per_shard, slot, []
                parts.append(struct.pack(HEADER, -1 if doc_id is None else doc_id, piece, len(tokens) // width) + tokens + fill[len(tokens) :])
        if parts:
            yield shard_row(shard, first, parts)

    return run


def shards(docs: DataFrame, length: int = LENGTH, per_shard: int = RECORDS, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per shard: shard, first_slot, n_sequences, stride, payload.

    The payload is the shard's file: n_sequences records of stride bytes by
    ascending slot, so slot s is at (s - first_slot) * stride of shard
    s // per_shard. All shards but the last have per_shard records. A null, empty
    or tokenless text has no sequence, a text of any length is encoded whole; repeated rows are sequences each for itself; a null
    doc_id is written as -1. Extra columns are ignored; an empty table gives no row.
    Which slot a sequence gets depends on the key, on N and on how the input is split into tasks.
    """
    own, total = sequences(docs, length, key, vocabulary)
    out = "shard long, first_slot long, n_sequences long, stride int, payload binary"
    ranges = max(1, math.ceil(total / per_shard))
    placed = own.repartitionById(ranges, F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot")
    return placed.mapInArrow(_records(length, per_shard, vocabulary), out)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(found: DataFrame, uri: str) -> DataFrame:
    """Writes each shard's payload to a file of its own under ``uri`` (any file system pyarrow knows).

    A file is written under another name and then moved, so a task that runs
    again replaces it with the same bytes. Returns one row per file: shard,
    first_slot, n_sequences, stride, n_bytes, crc32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(uri)
        files.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                target = f"{root}/{shard_name(r['shard'])}"
                part = f"{target}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as f:
                    f.write(r["payload"])
                files.move(part, target)
                rows.append({k: r[k] for k in ("shard", "first_slot", "n_sequences", "stride")} | {"n_bytes": len(r["payload"]), "crc32": zlib.crc32(r["payload"])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int64()), ("stride", pa.int32()), ("n_bytes", pa.int64()), ("crc32", pa.int64())]))

    return found.mapInArrow(run, "shard long, first_slot long, n_sequences long, stride int, n_bytes long, crc32 long")


def read_slots(uri: str, start: int, count: int, length: int = LENGTH, per_shard: int = RECORDS, vocabulary: str = VOCABULARY) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, piece, ids) of ``count`` slots from ``start`` on, read sequentially."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(uri)
    # A shard missing before the last one is an error, not the end.
    last = max((int(f.base_name[6:-4]) for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("shard-") and f.base_name.endswith(".bin")), default=-1)
    size, slot, kind = stride(length, vocabulary), start, f"<u{id_bytes(vocabulary)}"
    while slot < start + count:
        shard, k = divmod(slot, per_shard)
        if shard > last:
            return
        with files.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(k * size)
            while slot < start + count and slot // per_shard == shard:
                record = f.read(size)
                if len(record) < size:
                    return
                doc_id, piece, n = struct.unpack_from(HEADER, record)
                yield doc_id, piece, np.frombuffer(record, dtype=kind, count=n, offset=HEADER_BYTES)
                slot += 1


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"))


QUERIES = {"op4_training_order": op4_training_order}
SQL: dict[str, str] = {}
