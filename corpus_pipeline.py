"""A corpus pipeline of five stages over ``documents``.

Toxic documents go, one document of each group of near duplicates stays,
documents with benchmark passages go, live-looking secrets are replaced, and what
remains is packed into sequences. Every stage takes (spark, docs, sf_dir); its
result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ridgeline.checkpoints import remove, scratch
from ridgeline.llm.common import read
from ridgeline.llm.decontaminate import drop_contaminated
from ridgeline.llm.near_dedup import keep_one_of_each
from ridgeline.llm.packing import pack
from ridgeline.llm.secrets import redact_secrets
from ridgeline.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows that score below the threshold, columns as they were (see ``drop_toxic``); rows without text stay. The lexicon learns from the labelled documents."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one row of each group of near duplicates, columns as they were (see ``keep_one_of_each``); rows without doc_id stay."""
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rows without a passage of the benchmark, columns as they were (see ``drop_contaminated``); rows without text stay."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every row, with live-looking secrets replaced and n_chars brought up to date (see ``redact_secrets``)."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one row per piece of a document in a sequence (see ``pack``); rows without text have none."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Learned terms, sketches and sequential placing can't be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; tables in between go to the shared folder and are removed once the next one is written."""
    folder = scratch(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
