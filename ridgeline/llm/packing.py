"""Cost-balanced packing of documents into training sequences.

A document of n tokens costs LINEAR * n + QUADRATIC * n * n: attention within
the document is quadratic, everything else linear. Documents are taken by
descending size and each goes to the sequence of lowest cost that still has room.
A document longer than a sequence is split into pieces of a whole sequence and a
rest, so that all of its tokens are packed.

Placing is sequential by nature, so documents are hashed into shards of about
``shard_tokens`` tokens, packed independently of each other; only
(doc_id, n_tokens) is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import cut, read
from ridgeline.llm.tokens import VOCABULARY, count_column

CAPACITY = 4096
LINEAR = 1.0
#: Attention against the rest for a width of 4096: 2 n d against 12 d d for each token.
QUADRATIC = 1.0 / (6 * 4096)
SHARD_TOKENS = 8_000_000


def cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def assign(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place within it) of each piece; sizes descend and none exceeds the capacity.

    As many sequences are opened at first as the tokens need at least, another
    one whenever a piece has no room anywhere. Of equal costs the first wins.
    """
    first = max(1, math.ceil(int(sizes.sum()) / capacity))
    size = first + 16
    room, load = np.zeros(size, dtype=np.int64), np.full(size, np.inf)
    room[:first], load[:first] = capacity, 0.0
    used, filled = first, np.zeros(size, dtype=np.int64)
    where, place = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for i, n in enumerate(sizes):
        s = int(np.where(room >= n, load, np.inf).argmin())
        if room[s] < n or not np.isfinite(load[s]):
            if used == len(room):
                room, load = np.concatenate([room, np.zeros(used, np.int64)]), np.concatenate([load, np.full(used, np.inf)])
                filled = np.concatenate([filled, np.zeros(used, np.int64)])
            s, used = used, used + 1
            room[s], load[s] = capacity, 0.0
        where[i], place[i] = s, filled[s]
        filled[s] += 1
        room[s] -= n
        load[s] += linear * n + quadratic * n * n
    return where, place


_OUT = "doc_id long, piece int, first_token long, n_tokens int, shard int, sequence int, place int, cost double"


def pack_counted(counted: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Packs rows of (doc_id, n_tokens)."""
    total = counted.agg(F.sum(F.col("n_tokens").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    pieces = (
        counted.where("n_tokens > 0")
        .select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece").cast("long") * capacity).alias("first_token"),
            F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n_tokens"),
            F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int").alias("shard"),
        )
    )

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        n = rows["n_tokens"].to_numpy()
        rows["sequence"], rows["place"] = assign(n, capacity, linear, quadratic)
        rows["cost"] = cost(n.astype(float), linear, quadratic)
        return rows[["doc_id", "piece", "first_token", "n_tokens", "shard", "sequence", "place", "cost"]]

    return pieces.groupBy("shard").applyInPandas(pack, _OUT)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """One row per packed piece: doc_id, piece, first_token, n_tokens, shard, sequence, place, cost.

    (shard, sequence) names a sequence; the pieces of one are ordered by place.
    A null, empty or tokenless text has nothing to pack and gives no row; a text of any
    length, white space included, is counted and packed whole. Repeated
    rows are packed each for itself; null doc_ids stay null. Ties go by doc_id and
    piece. Extra columns are ignored.
    """
    counted = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), count_column(F.col("text"), vocabulary).alias("n_tokens")))
    return pack_counted(counted, capacity, **options)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}
