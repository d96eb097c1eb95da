"""Toxicity from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes disguises: marks and invisible characters are dropped, letters of other scripts
that look Latin become Latin, digits and signs inside a word become the letters they stand
for, i, l and 1 are one letter, letters set apart (i d i o t) are put together, and a letter three times or more
in a row counts as one or as two. A term counts where it stands as a word, not inside an exception phrase, and not
in a language in which it is an ordinary word. A text's score is the sum of the weights of its
matches for every hundred words.

The lexicon has two parts: terms listed here, and terms learned from the labelled
documents, whose weight is their log odds between toxic and other documents. What
is learned from is a bounded sample of the labelled rows (``MAX_TOXIC``,
``MAX_CLEAN``, the least hashes of doc_id), what is scored is every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import fold, read

#: Weights from 1 (rude) to 5 (abusive).
LEXICON: dict[str, float] = {
    "idiot": 4, "idiots": 4, "idiotic": 3, "moron": 4, "morons": 4, "moronic": 3, "stupid": 3, "loser": 3, "losers": 3,
    "scum": 4, "scumbag": 5, "scumbags": 5, "trash": 3, "worthless": 3, "pathetic": 3, "disgusting": 3, "clown": 3, "clowns": 3,
    "imbecile": 4, "imbeciles": 4, "dumbass": 5, "retard": 5, "retarded": 5, "bastard": 4, "bastards": 4, "vermin": 4,
    "subhuman": 5, "filth": 3, "filthy": 2, "degenerate": 3, "degenerates": 3, "lowlife": 4, "dimwit": 3, "halfwit": 3,
    "asshole": 5, "assholes": 5, "bitch": 5, "bitches": 5, "bullshit": 3, "shit": 3, "shitty": 3, "fuck": 4, "fucking": 4,
    "fucker": 5, "fuckers": 5, "whore": 5, "slut": 5, "cunt": 5, "crap": 2, "crappy": 2, "jerk": 2, "kill yourself": 5,
    "go to hell": 3, "shut up": 2, "piece of shit": 5, "drecksau": 5, "arschloch": 5, "schlampe": 5, "hurensohn": 5,
    "connard": 5, "salope": 5, "encule": 5, "putain": 3, "gilipollas": 5, "puta": 4, "mierda": 3, "cabron": 4, "pendejo": 4,
}
#: Phrases in which a term is not meant as abuse.
EXCEPTIONS: tuple[str, ...] = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "take out the trash", "clown fish", "class clown",
    "circus clown", "pond scum", "algae scum", "soap scum", "stupid simple", "keep it simple stupid", "moron prefecture",
    "jerk chicken", "jerk seasoning", "degenerate matter", "degenerate orbitals", "pathetic fallacy", "worthless security deduction",
    "idiot proof", "sore loser rule", "shit happens", "retard timing", "fire retarded", "hot mess",
    *(f"{word} retard" for word in ("le", "un", "du", "de", "en", "ce", "son", "mon", "notre", "leur", "sans", "quelque", "aucun", "gros", "grand", "leger", "tout")),
    *(f"retard {word}" for word in ("de", "du", "des", "dans", "sur", "scolaire", "mental")),
)
#: Terms that are ordinary words in a language, by the code in ``lang``.
ORDINARY: dict[str, tuple[str, ...]] = {"fr": ("retard",), "de": (), "es": ()}
MAX_TOXIC, MAX_CLEAN = 5_000, 20_000
MIN_TOXIC_DOCS, MIN_TOXIC_SHARE, MIN_LOG_ODDS = 8, 0.0125, 3.5
THRESHOLD = 1.5

#: Cyrillic, Greek, other Latin, small capitals, Armenian.
_LOOKALIKE = str.maketrans(
    "авеёкмнорстухіїјѕԁԛԝһӏҽԍѵѡ" + "αβεηικνορτυχωγμ" + "ıłøđɡðɑɩ" + "ɪʟʀɴʙᴄᴅᴇꜰɢʜᴊᴋᴍᴏᴘꜱᴛᴜᴠᴡʏᴢ" + "օսոհցզ",
    "abeekmhopctyxiijsdqwhlegvw" + "abenikvoptuxwyu" + "ilodgdai" + "ilrnbcdefghjkmopstuvwyz" + "ounhgq",
)
_DIGITS = str.maketrans("0134578", "oieastb")
_L = str.maketrans("l", "i")
_SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e", "|": "i"}
_SIGN_RUN = re.compile(r"[@$!€|]+")


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _sign(m: re.Match) -> str:
    """Signs between letters stand for letters; so does one @ or $ that begins a word."""
    before, after = m.string[max(0, m.start() - 1) : m.start()], m.string[m.end() : m.end() + 1]
    if not after or not _in_word(after):
        return m[0]
    if before and _in_word(before):
        return "".join(_SIGNS[c] for c in m[0])
    return m[0][:-1] + _SIGNS[m[0][-1]] if m[0][-1] in "@$" and after != "_" and not after.isdecimal() else m[0]


#: Three letters or more that stand by themselves.
_APART = re.compile(r"(?<![^ ])[a-z](?: [a-z](?![^ ])){2,}+")
_THRICE = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_RUN = re.compile(r"([a-z])\1\1+")


def unsigned(text: str) -> str:
    """The text with signs that stand for letters replaced by them."""
    return _SIGN_RUN.sub(_sign, text) if any(c in text for c in _SIGNS) else text


def _folded(text: str) -> tuple[str, int]:
    """What is scanned of a text, and how many words the text has."""
    out = fold(unsigned(text))
    if not out:
        return "", 0
    words = out.count(" ") + 1
    if not out.isascii():
        out = out.translate(_LOOKALIKE)
    if any(d in out for d in "0134578"):
        # Words of letters and digits; numbers stay.
        out = " ".join([w if w.isalpha() or w.isdigit() or not w.isascii() else w.translate(_DIGITS) for w in out.split(" ")])
    out = out.translate(_L) if out.isascii() else out.replace("l", "i")
    out = _APART.sub(lambda m: m[0].replace(" ", ""), out)
    if any(t in out for t in _THRICE):
        out = " ".join(f"{_RUN.sub(r'\1\1', w)} {_RUN.sub(r'\1', w)}" if _RUN.search(w) else w for w in out.split(" "))
    return out, words


def disguise_folded(text: str) -> str:
    """Folded words with lookalikes and digit substitutions undone, i for l and 1, letters set apart put together; numbers stay."""
    return _folded(text)[0]


def build(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, ordinary: dict[str, tuple[str, ...]] = ORDINARY) -> ahocorasick.Automaton:
    """Patterns with a space on either side and (length, weight, languages in which it is no abuse); an exception phrase has weight None."""
    a = ahocorasick.Automaton()
    weights: dict[str, float] = {}
    for term, w in lexicon.items():
        key = f" {disguise_folded(term)} "
        weights[key] = max(w, weights.get(key, 0))
    spared: dict[str, list[str]] = {}
    for lang, terms in ordinary.items():
        for term in terms:
            spared.setdefault(f" {disguise_folded(term)} ", []).append(lang)
    for key, w in weights.items():
        if key.strip():
            a.add_word(key, (len(key), w, tuple(spared.get(key, ()))))
    for phrase in exceptions:
        key = f" {disguise_folded(phrase)} "
        if key.strip():
            a.add_word(key, (len(key), None, ()))
    a.make_automaton()
    return a


def score_text(automaton: ahocorasick.Automaton, text: str | None, lang: str | None = None) -> tuple[float, int]:
    """(score, matches) of one text; (0, 0) for a null or wordless one."""
    folded, words = _folded(text) if text else ("", 0)
    if not folded:
        return 0.0, 0
    hits, safe = [], []
    for end, (n, w, spared) in automaton.iter(f" {folded} "):
        if w is None:
            safe.append((end - n + 1, end))
        elif lang not in spared:
            hits.append((end - n + 1, end, w))
    if safe and hits:
        # One sweep by start: a hit is covered if some phrase that began before it ends after it.
        safe.sort()
        hits.sort()
        kept, k, reach = [], 0, -1
        for hit in hits:
            while k < len(safe) and safe[k][0] <= hit[0]:
                reach = max(reach, safe[k][1])
                k += 1
            if hit[1] > reach:
                kept.append(hit)
        hits = kept
    return sum(h[2] for h in hits) / words * 100, len(hits)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = sorted(set(disguise_folded(text).split()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.int32())], names=["term", "toxic"])


def learned_lexicon(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> dict[str, float]:
    """Terms that mark toxic documents among the labelled sample, with weights from 1 to 5.

    A document with two different labels counts as toxic. Texts that are equal
    count once. A term needs MIN_TOXIC_DOCS toxic documents, MIN_TOXIC_SHARE of
    them (more than the copies of one text make up), and log odds of
    MIN_LOG_ODDS; without labels nothing is learned.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id is not null and __toxic is not null")
    own = own.groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    order = F.xxhash64("__id"), F.col("__id")
    sample = own.where("__toxic > 0").orderBy(*order).limit(max_toxic).unionByName(own.where("__toxic <= 0").orderBy(*order).limit(max_clean))
    # At most max_toxic + max_clean pairs of numbers, whatever the input.
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"))
        .where("__text is not null")
        .join(F.broadcast(sample), "__id")
        .groupBy(F.sha2("__text", 256).alias("__key"))
        .agg(F.first("__text").alias("text"), F.max(F.when(F.col("__toxic") > 0, 1).otherwise(0)).alias("toxic"))
        .select("text", "toxic")
    )
    terms = texts.mapInArrow(_terms, "term string, toxic int")
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("good")).first()
    if not totals.bad or not totals.good:
        return {}
    odds = F.log((F.col("bad") + 0.5) / (totals.bad + 1.0)) - F.log((F.col("good") + 0.5) / (totals.good + 1.0))
    rows = counts.where(F.col("bad") >= max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * totals.bad)).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS).collect()
    return {r.term: min(5.0, max(1.0, round(r.odds - 2, 2))) for r in rows if not r.term.isdigit()}


_SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("matches", T.IntegerType())])
_BUILT: dict[int, tuple] = {}


def _built(terms: tuple[dict[str, float], tuple[str, ...]]) -> ahocorasick.Automaton:
    """The automaton of some terms; kept in the worker, which gets the same object for all tasks of a query."""
    if id(terms) not in _BUILT:
        if len(_BUILT) > 8:
            _BUILT.clear()
        _BUILT[id(terms)] = (terms, build(*terms))
    return _BUILT[id(terms)][1]


def score_column(spark: SparkSession, lexicon: dict[str, float], text: Column, lang: Column | None = None, exceptions: tuple[str, ...] = EXCEPTIONS) -> Column:
    shared = spark.sparkContext.broadcast((lexicon, exceptions))

    @F.arrow_udf(_SCORE)
    def score(texts: pa.Array, langs: pa.Array) -> pa.Array:
        automaton = _built(shared.value)
        found = [score_text(automaton, t, g) for t, g in zip(texts.to_pylist(), langs.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())], names=["score", "matches"])

    return score(text.cast("string"), (F.lit(None) if lang is None else lang).cast("string"))


def _scored(docs: DataFrame, terms: dict[str, float]) -> Column:
    return score_column(docs.sparkSession, terms, F.col("text"), F.col("lang") if "lang" in docs.columns else None)


def toxicity(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, lexicon: dict[str, float] | None = None) -> DataFrame:
    """One row per document row: doc_id, score, toxic.

    toxic is true where the score reaches the threshold. A null, empty or
    wordless text scores 0; texts of any length are scanned whole. A column ``lang``, if there is one,
    spares words that are ordinary in that language. Repeated rows repeat their result, a null doc_id
    stays null, extra columns are ignored; an empty table gives no row.
    """
    terms = _lexicon(docs, labels, lexicon)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _scored(docs, terms).alias("s"))
    return own.select("doc_id", F.col("s.score").alias("score"), (F.col("s.score") >= threshold).alias("toxic"))


def _lexicon(docs: DataFrame, labels: DataFrame | None, lexicon: dict[str, float] | None) -> dict[str, float]:
    base = LEXICON if lexicon is None else lexicon
    learned = learned_lexicon(docs, labels) if labels is not None else {}
    # Terms listed are spelled as usual, terms learned are folded; build() keeps the larger weight.
    return learned | {t: max(w, learned.get(disguise_folded(t), 0)) for t, w in base.items()}


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, lexicon: dict[str, float] | None = None) -> DataFrame:
    """The document rows below the threshold, columns as they were; no shuffle.

    Rows stay or go each for itself, so repeated rows all stay or all go; rows with a null, empty or wordless text
    stay, as do those with a null doc_id. Of an empty table nothing is left. Extra columns of any name are kept.
    """
    return docs.where(_scored(docs, _lexicon(docs, labels, lexicon))["score"] < threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
