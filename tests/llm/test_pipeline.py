"""The pipeline's rows against a plain version of its stages."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from ridgeline import checkpoints
from ridgeline.llm import common, decontaminate, near_dedup, packing, tokens, toxicity
from tests.compare import SMALL
from tests.llm.test_operators import odd, plain_packing, plain_redaction


def test_run_against_plain_code(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    d, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    automaton = toxicity.build(toxicity._lexicon(d, labels, None))
    kept = {i: r.text for i, r in docs.items() if toxicity.score_text(automaton, r.text, r.lang)[0] < toxicity.THRESHOLD}
    # Every pair of sketches, without bands.
    ids = sorted(i for i in kept if common.fold(kept[i] or ""))
    sketches = near_dedup.odd_sketches(near_dedup.minima([common.fold(kept[i]) for i in ids]))
    limit, root = near_dedup.most_bits(near_dedup.THRESHOLD), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    import numpy as np

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(sketches[:a] ^ sketches[a]).sum(axis=1) <= limit) if a else ():
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if i not in root or find(i) == i}
    windows = [f" {w} " for _, t in items for w in decontaminate.windows(t)]
    kept = {i: t for i, t in kept.items() if not any(w in f" {common.fold(t or '')} " for w in windows)}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == {i for i, t in kept.items() if t}
    # Redacted texts, counted over what is kept, and packed.
    enc, texts = tokens.encoding(), plain_redaction([(i, docs[i].text, docs[i].lang, docs[i].source, 0) for i in kept])
    sizes = collections.Counter()
    for r in got:
        sizes[r.doc_id] += r.n_tokens
    assert sizes == {i: len(enc.encode_ordinary(t)) for i, t in texts.items() if t}
    for s in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == s), key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
        assert [r.sequence for r in own] == plain_packing([r.n_tokens for r in own], packing.CAPACITY, packing.LINEAR, packing.QUADRATIC)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_stages_take_odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and clashing columns, through every stage in turn."""
    df = odd(spark).unionByName(odd(spark).where("doc_id = 106").withColumn("text", F.lit("a" + " " * 1_200_000 + "trash trash can " * 50_000 + "b")).withColumn("doc_id", F.lit(107)))
    df, stages = df.withColumn("gone", F.lit("clash")).withColumn("live_values", F.lit("clash")), corpus_pipeline.STAGES
    after = []
    for _, stage in stages[:-1]:
        df = stage(spark, df, SMALL)
        after.append(collections.Counter(r.doc_id for r in df.select("doc_id").collect()))
    assert after[0] == {None: 2, 101: 2, 102: 1, 103: 1, 104: 1, 105: 1, 106: 2}
    assert after[1] == after[2] == after[3] == {None: 2, 101: 1, 102: 1, 103: 1, 104: 1, 105: 1, 106: 1}
    assert {r.doc_id for r in stages[-1][1](spark, df, SMALL).collect()} == {103, 104, 105, 106}
    assert df.columns == [*odd(spark).columns, "gone", "live_values"]


def test_tables_in_between_are_removed(spark):
    import os

    folder = checkpoints.ensure_checkpoint_dir(spark)
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SMALL)
    (new,) = (n for n in set(os.listdir(folder)) - before if n.startswith("pipeline-"))
    assert os.listdir(f"{folder}/{new}") == ["4-packing"]
