"""Quality with hierarchical empirical Bayes over sites.

A logistic classifier over the make-up of each text gives its evidence. Grouped
aggregation sums that evidence by path and by host; a host's rate is shrunk toward
the global rate and a path's rate toward its host's, the more so the fewer
documents it has. The strength of each prior is fitted by the method of moments
from how rates vary between the groups. A document's posterior odds are its own
odds, moved by how far its path's rate (without the document itself) lies from
the global one.

``documents`` has no address, so by default the host is ``source`` and the path
``source/lang``; both are parameters. The classifier is fitted on a bounded sample
of the labelled rows (``MAX_LABELLED`` of each class, the least hashes of doc_id);
evidence and rates cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import chunks_by_size, cut, read

MAX_LABELLED = 10_000
STEPS, RATE, L2 = 400, 0.5, 1e-3
#: A prior weighs at most so many documents.
MAX_STRENGTH = 10_000.0
#: Rates are held this far from 0 and 1 where odds are taken of them.
EDGE = 0.001

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other
for _c in range(256):
    ch = chr(_c)
    if _c >= 128 or (_c < 128 and ch.islower()):
        _CLASS[_c] = 1
    elif ch.isupper():
        _CLASS[_c] = 2
    elif ch.isdigit():
        _CLASS[_c] = 3
    elif ch in " \t":
        _CLASS[_c] = 4
    elif ch == "\n":
        _CLASS[_c] = 5
    elif ch in ".,;:'\"-()?":
        _CLASS[_c] = 6
    elif ch == "!":
        _CLASS[_c] = 7
    elif ch == "|":
        _CLASS[_c] = 8
_CLASSES = 9
FEATURES = _CLASSES + 4


def features(texts: list[str]) -> np.ndarray:
    """One row for each non-empty text: shares of character classes, repetition, length."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    kinds = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(raw)), sizes)
    counts = np.bincount(owner * _CLASSES + kinds, minlength=len(raw) * _CLASSES).reshape(-1, _CLASSES)
    out = np.empty((len(raw), FEATURES))
    out[:, :_CLASSES] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    for i, t in enumerate(texts):
        words = t.split()
        n = max(1, len(words))
        same = sum(a == b for a, b in zip(words, words[1:]))
        out[i, _CLASSES:] = len(set(words)) / n, same / n, min(20.0, len(t) / n) / 20, np.log1p(n) / 12
    return out


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier, the last one its constant; classes count equally."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= RATE * 4 * (z.T @ ((p - y) * balance) + L2 * np.append(w[:-1], 0))
    return np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum())


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["good", "x"])


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> np.ndarray:
    """Weights from the labelled documents; zeros if a class is missing. A doc_id with two labels counts as bad."""
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__good")).where("__id is not null and __good is not null")
    own = own.groupBy("__id").agg(F.min("__good").alias("__good"))
    order = F.xxhash64("__id"), F.col("__id")
    sample = own.where("__good > 0").orderBy(*order).limit(bound).unionByName(own.where("__good <= 0").orderBy(*order).limit(bound))
    # At most twice ``bound`` pairs of numbers, whatever the input.
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
        .where("text is not null and text <> ''")
        .join(F.broadcast(sample), "__id")
        .select("text", "__good")
        .mapInArrow(_features_of, "good int, x array<double>")
        .collect()
    )
    y = np.array([1.0 if r.good > 0 else 0.0 for r in rows])
    if not len(y) or y.min() == y.max():
        return np.zeros(FEATURES + 1)
    order = np.lexsort(np.array([r.x for r in rows]).T)
    return fit(np.array([rows[i].x for i in order]), y[order])


def _evidence(weights: np.ndarray):
    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        own, out = texts.to_pylist(), np.zeros(len(texts))
        some = [i for i, t in enumerate(own) if t]
        for a, b in chunks_by_size([len(own[i]) for i in some], 1 << 21):
            out[some[a:b]] = features([own[i] for i in some[a:b]]) @ weights[:-1] + weights[-1]
        out[[i for i, t in enumerate(own) if not t]] = np.nan
        return pa.array(np.clip(out, -12, 12), pa.float64(), from_pandas=True)

    return evidence


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents a group's prior weighs, by the method of moments, from grouped sums in Spark.

    The variance of rates between groups is what their spread about the prior has beyond the noise of mean * (1 - mean) a document;
    the strength is mean * (1 - mean) over it, less one. It is between 1 and MAX_STRENGTH, which also
    stands for rates that don't vary beyond noise and for fewer than two groups.
    """
    r = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("prior"), 2)).alias("s")).first()
    if not r.n or r.g < 2 or not 0 < mean < 1:
        return MAX_STRENGTH
    within = mean * (1 - mean)
    between = max(r.s / r.n - within * r.g / r.n, 1e-9)
    return min(MAX_STRENGTH, max(1.0, within / between - 1))


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per document row: doc_id, evidence (log odds), site_rate, probability, keep.

    A null or empty text has no evidence: its evidence is null, its probability
    its site's rate, and it is not kept. A null host or path counts as one group
    of its own, as does a column ``source`` or ``lang`` that isn't there. Without labels of both classes all evidence
    is 0. A probability that equals the threshold is kept. Texts are read whole. Repeated rows
    count each for itself, a null doc_id stays null, extra columns are ignored; an empty table gives no row.
    """
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("source", "lang"))
    host = source if host is None else host
    path = F.concat_ws("/", source, lang) if path is None else path
    weights = train(docs, labels)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        _evidence(weights)(F.col("text").cast("string")).alias("evidence"),
    )
    own = cut(own.withColumn("p", F.when(F.col("evidence").isNotNull(), 1 / (1 + F.exp(-F.col("evidence"))))))
    # Sums over groups are rounded, so that the order of adding doesn't show.
    paths = cut(own.groupBy("host", "path").agg(F.count("p").alias("n"), F.round(F.coalesce(F.sum("p"), F.lit(0.0)), 6).alias("total")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    r = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total")).first()
    mean = min(1 - EDGE, max(EDGE, r.total / r.n)) if r.n else 0.5
    a = _strength(hosts.where("n > 0").withColumn("prior", F.lit(mean)), mean)
    rated = hosts.withColumn("host_rate", (F.col("total") + a * mean) / (F.col("n") + a)).select("host", "host_rate")
    under = cut(paths.join(rated, "host"))
    b = _strength(under.where("n > 0").withColumn("prior", F.col("host_rate")), mean)
    rest = F.greatest(F.col("n") - F.when(F.col("p").isNotNull(), 1).otherwise(0), F.lit(0))
    site = F.round((F.greatest(F.col("total") - F.coalesce("p", F.lit(0.0)), F.lit(0.0)) + b * F.col("host_rate")) / (rest + b), 6)
    odds = lambda c: F.log(c / (1 - c))
    clipped = F.least(F.greatest(F.col("site_rate"), F.lit(EDGE)), F.lit(1 - EDGE))
    shift = odds(clipped) - float(np.log(mean / (1 - mean)))
    out = own.join(under, ["host", "path"]).withColumn("site_rate", site)
    out = out.withColumn("probability", F.round(F.when(F.col("evidence").isNull(), F.col("site_rate")).otherwise(1 / (1 + F.exp(-(F.col("evidence") + shift)))), 6))
    keep = F.col("evidence").isNotNull() & (F.col("probability") >= threshold)
    return out.select("doc_id", F.round("evidence", 6).alias("evidence"), "site_rate", "probability", keep.alias("keep"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}
