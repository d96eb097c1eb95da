"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are folded to words (see ``common.fold``) and cut into windows of 13
words; an item of 5 to 13 words is one window. A shorter item, such as an answer of one word, occurs by
chance in texts about anything, so it counts only where it is a text's words from first to last.
All windows form one automaton, built once in each Python worker, and every text is folded and
scanned once, whole. Only a text with a match is folded again character by character, to give
offsets in the original.

The automaton grows with the benchmark, not with the documents. What is
broadcast is measured first: beyond ``max_pattern_chars`` the items are split by item_id
into as many automata as it takes, and each scans the texts; the rows are the same.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import fold, fold_with_offsets, read

WINDOW, MIN_WORDS = 13, 5
MAX_PATTERN_CHARS = 8_000_000

_SPAN = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("item_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())]))
_BUILT: dict[tuple, tuple] = {}


def windows(text: str | None, size: int = WINDOW, least: int = MIN_WORDS) -> list[str]:
    """The word windows that stand for one test item; none if it has fewer than ``least`` words."""
    words = fold(text or "").split()
    if len(words) < least:
        return []
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def build(items: list[tuple[int, str]], size: int = WINDOW, least: int = MIN_WORDS) -> ahocorasick.Automaton | None:
    """Patterns with a space on either side and (length, item_ids, whether the text must be no more than it)."""
    owners: dict[str, set[int]] = {}
    short: dict[str, set[int]] = {}
    for item_id, text in items:
        found = windows(text, size, least)
        for w in found:
            owners.setdefault(f" {w} ", set()).add(item_id)
        if not found and (whole := fold(text)):
            short.setdefault(f" {whole} ", set()).add(item_id)
    if not owners and not short:
        return None
    a = ahocorasick.Automaton()
    # Short items have fewer words than any window, so no pattern is both.
    for patterns, whole in ((owners, False), (short, True)):
        for pattern, ids in patterns.items():
            a.add_word(pattern, (len(pattern), tuple(sorted(ids)), whole))
    a.make_automaton()
    return a


def spans(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, int]]:
    """(item_id, start, end) in the original text; windows of an item that overlap or touch are one span."""
    folded = fold(text)
    found: dict[int, list[list[int]]] = {}
    for end, (n, ids, whole) in automaton.iter(f" {folded} "):
        if whole and n != len(folded) + 2:
            continue
        # The pattern's outer spaces aren't part of the match; the text got one space before it.
        start, stop = end - n + 1, end - 1
        for item in ids:
            own, first, last = found.setdefault(item, []), start, stop
            while own and first <= own[-1][1] + 1:
                a, b = own.pop()
                first, last = min(first, a), max(last, b)
            own.append([first, last])
    if not found:
        return []
    again, at = fold_with_offsets(text)
    assert again == folded
    return sorted((item, int(at[a]), int(at[b - 1]) + 1) for item, own in found.items() for a, b in own)


def _built(items: list[tuple[int, str]], size: int, least: int) -> ahocorasick.Automaton | None:
    """The automaton of some items; kept in the worker, which gets the same list for all tasks of a query."""
    key = id(items), size, least
    if key not in _BUILT:
        if len(_BUILT) > 8:
            _BUILT.clear()
        _BUILT[key] = (items, build(items, size, least))
    return _BUILT[key][1]


def _scanner(shared, size: int, least: int):
    @F.arrow_udf(_SPAN)
    def scan(text: pa.Array) -> pa.Array:
        automaton = _built(shared.value, size, least)
        out = [
            [{"item_id": i, "start_char": a, "end_char": b} for i, a, b in spans(automaton, t)] if automaton is not None and t else []
            for t in text.to_pylist()
        ]
        return pa.array(out, _ARROW_SPAN)

    return scan


def span_columns(
    spark: SparkSession, benchmark: DataFrame, text: Column, window: int = WINDOW, min_words: int = MIN_WORDS, max_pattern_chars: int = MAX_PATTERN_CHARS
) -> list[Column]:
    """Columns of spans, one for each automaton."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    # A window repeats in its neighbours: the automaton holds about `window` times the items' text.
    sizes = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars"), F.countDistinct("i").alias("ids")).first()
    parts = max(1, min(sizes.ids, math.ceil(sizes.chars * window / max_pattern_chars)))
    out = []
    for k in range(parts):
        own = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).distinct().orderBy("i", "t").collect()]
        out.append(_scanner(spark.sparkContext.broadcast(own), window, min_words)(text))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document row and stretch of a test item in it: doc_id, item_id, start_char, end_char.

    Offsets count characters of the original text, end exclusive. Windows of one
    item that overlap are one stretch; a text in which an item occurs again gets
    a row for each. Null, empty or wordless texts and items have no match, nor has an item without
    an id; an item of fewer than ``min_words`` words matches a text of just its words;
    items that share an id are scanned for as one. Repeated rows repeat their
    result; a null doc_id stays null. Texts are scanned whole, extra columns ignored; an empty table of either kind gives no row.
    """
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    cols = span_columns(docs.sparkSession, benchmark, F.col("text"), **options)
    found = own.select("doc_id", F.concat(*cols).alias("s")) if len(cols) > 1 else own.select("doc_id", cols[0].alias("s"))
    return found.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.item_id", "s.start_char", "s.end_char")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The document rows without a stretch of a test item (see ``contamination``), columns as they were; no shuffle.

    Rows stay or go each for itself, so repeated rows all stay or all go; rows with a null, empty or wordless text
    stay, as do clean ones with a null doc_id. Without test items all rows stay. Extra columns of any name are kept.
    """
    cols = span_columns(docs.sparkSession, benchmark, F.col("text").cast("string"), **options)
    for c in cols:
        docs = docs.where(F.size(c) == 0)
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
SQL: dict[str, str] = {}
