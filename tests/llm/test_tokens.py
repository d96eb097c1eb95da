"""Token ids against the plain encoder, and whole shards against plain code."""

import random
import struct

import numpy as np
import pytest

from ridgeline.llm import materialise, packing, tokens
from tests.llm.test_operators import docs, prose

BLANKS = ["\t", "\n", " ", "\r", "\v", "\f", "　", "\xa0", "\x85", " ", " ", " "]


@pytest.mark.parametrize("seed", range(40))
def test_long_runs_have_the_ids_of_the_plain_encoder(seed):
    rng, enc = random.Random(seed), tokens.encoding()
    text = ""
    for _ in range(6):
        n = rng.choice([0, 1, 2, tokens.LONG_RUN - 1, tokens.LONG_RUN, tokens.LONG_RUN + 1, 5000])
        run = "".join(rng.choices(BLANKS, k=n)) if rng.random() < 0.5 else rng.choice(BLANKS) * n
        text += rng.choice(["", "a", "b1", "!", "'s", "é", "\x1c", "word"]) + run
    assert tokens.encode(enc, text) == enc.encode_ordinary(text)


LONG = {"blanks": "a" + " " * 3_000_000 + "b", "lines": "\n" * 2_000_000, "word": "a" * 3_000_000, "digits": "1" * 1_000_000, "signs": "!?" * 1_000_000}


@pytest.mark.parametrize("name", sorted(LONG))
def test_very_long_texts_are_packed_and_ordered_whole(spark, name):
    text, enc = LONG[name], tokens.encoding()
    ids = tokens.encode(enc, text)
    assert enc.decode(ids) == text
    assert sum(r.n_tokens for r in packing.pack(docs(spark, [(1, text), (2, "b")])).collect() if r.doc_id == 1) == len(ids)
    table, total = materialise.sequences(docs(spark, [(1, text)]))
    assert total == -(-(len(ids) + 1) // materialise.LENGTH)
    got = b"".join(r.tokens for r in table.orderBy("piece").collect())
    assert np.array_equal(np.frombuffer(got, "<u2"), [*ids, tokens.end_mark()])


def plain_slot(x, n, key):
    """The keyed permutation in plain integers."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    m64 = (1 << 64) - 1

    def mix(v):
        v ^= v >> 30
        v = v * 0xBF58476D1CE4E5B9 & m64
        v ^= v >> 27
        v = v * 0x94D049BB133111EB & m64
        return v ^ v >> 31

    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for r in range(materialise.ROUNDS):
            left, right = right, left ^ (mix((right + (key + r * 0x9E3779B97F4A7C15)) & m64) & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_slots_against_plain_code(n):
    assert materialise.permute(np.arange(n), n, 99).tolist() == [plain_slot(i, n, 99) for i in range(n)]


def test_whole_shards_against_plain_code(spark):
    rows = [(k if k % 7 else None, prose(k, 5 + 13 * k % 90)) for k in range(60)] + [(70, ""), (71, None)]
    length, per_shard, key, enc = 32, 10, 5, tokens.encoding()
    own = []
    for i, t in rows:
        ids = [*enc.encode_ordinary(t), 50256] if t else []
        own += [(i, k // length, ids[k : k + length]) for k in range(0, len(ids), length)]
    placed = sorted((plain_slot(k, len(own), key), r) for k, r in enumerate(own))
    assert [s for s, _ in placed] == list(range(len(own)))
    want = {}
    for slot, (i, piece, ids) in placed:
        record = struct.pack("<qii", -1 if i is None else i, piece, len(ids)) + b"".join(struct.pack("<H", v) for v in ids + [50256] * (length - len(ids)))
        want[slot // per_shard] = want.get(slot // per_shard, b"") + record
    # One task, so that sequences are numbered in the order of the rows.
    got = materialise.shards(docs(spark, rows).coalesce(1), length, per_shard, key).collect()
    assert {r.shard: bytes(r.payload) for r in got} == want
    assert all(r.first_slot == r.shard * per_shard and r.stride == materialise.stride(length) for r in got)


def test_another_vocabulary(spark, tmp_path):
    """The end mark and the width of ids are the vocabulary's own."""
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (b + 70_000) for b in range(256)))
    assert tokens.end_mark(str(path)) == 70_256 and materialise.id_bytes(str(path)) == 4
    written = materialise.write_shards(materialise.shards(docs(spark, [(3, "héllo")]), 4, 2, vocabulary=str(path)), tmp_path.as_uri()).collect()
    assert [r.n_bytes for r in written] == [2 * (16 + 16)]
    back = [(d, p, ids.tolist()) for d, p, ids in materialise.read_slots(tmp_path.as_uri(), 0, 9, 4, 2, vocabulary=str(path))]
    ids = [b + 70_000 for b in "héllo".encode()] + [70_256]
    assert sorted(back, key=lambda r: r[1]) == [(3, 0, ids[:4]), (3, 1, ids[4:])]


def test_sequences_of_a_shard_hold_their_pieces_in_bounds(spark):
    """Several shards: each is packed by itself as plain code packs it, and no token is lost."""
    from tests.llm.test_operators import plain_packing

    rng = random.Random(2)
    counted = spark.createDataFrame([(k, rng.choice([64, 10, rng.randint(1, 300)])) for k in range(600)], "doc_id long, n_tokens int")
    got = packing.pack_counted(counted, 64, shard_tokens=10_000, linear=1.0, quadratic=0.5).collect()
    shards = {r.shard for r in got}
    assert len(shards) > 2 and sum(r.n_tokens for r in got) == sum(r.n_tokens for r in counted.collect())
    for s in shards:
        own = sorted((r for r in got if r.shard == s), key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
        assert [r.sequence for r in own] == plain_packing([r.n_tokens for r in own], 64, 1.0, 0.5)
