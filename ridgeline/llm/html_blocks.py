"""HTML extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text within one
block-level element, each with the path of tags above it. Every block is a vector
(hashed tag path, hashed words, a few shares and lengths), and a bidirectional
LSTM in numpy reads the whole sequence both ways before it labels each block as
content or not, so that a block is judged in the context of its document.

The labeller is trained here, on a bounded sample of pages (``TRAIN_PAGES``, the
least hashes of page_id). Its teacher is structure: blocks within main landmarks
(article, main) are content; blocks within nav, footer, aside, header, forms and
the like, and all outside of a page's main landmark, are not; other blocks of pages
without one teach nothing. In training, landmarks and class names are hidden from
half of the pages, so the labeller also learns from words, lengths and neighbours
and can label pages that have none.
"""

from __future__ import annotations

import bisect
import html
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import read

TRAIN_PAGES = 300
PATH_DIMS, WORD_DIMS, OTHER_DIMS = 32, 32, 8
INPUT = PATH_DIMS + WORD_DIMS + OTHER_DIMS
HIDDEN = 16
EPOCHS, BATCH_PAGES, LEARNING_RATE = 4, 16, 0.02
#: In training, longer pages are cut into stretches of so many blocks; labelling reads them whole.
TRAIN_BLOCKS = 200
THRESHOLD = 0.5

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*+)")
_ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Elements whose content is no text of the page; without an end they reach to the page's end.
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "noscript", "template")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_MAIN = frozenset({"article", "main"})
_AROUND = frozenset({"nav", "footer", "aside", "header", "form", "head", "button", "select", "menu", "dialog"})
_LANDMARKS = _MAIN | _AROUND
#: The first class name, or its first 32 characters.
_CLASS = re.compile(r"\bclass\s*+=\s*+[\"']?\s*+([a-zA-Z][\w-]{0,31})")
#: A path has at most so many tags; of those above, it begins with the innermost landmark.
PATH_TAGS = 256
_WORD = re.compile(r"\w+")


class _Ends:
    """Where tags end: at the first ``>`` outside of closed quotes; None where there is none.

    Scans that fail go through the same characters again and again in markup that
    never closes, so from the first failure on they follow a list of quotes
    and ``>``, and what has led nowhere once isn't followed again.
    """

    def __init__(self, page: str):
        self.page, self.at = page, None

    def find(self, start: int) -> int | None:
        if self.at is None:
            m = _ATTRIBUTES.match(self.page, start)
            if m:
                return m.end(1)
            found = [(m.start(), m[0]) for m in re.compile("[>\"']").finditer(self.page, start)]
            self.at, self.kind = [f[0] for f in found], [f[1] for f in found]
            self.failed, self.after = [False] * len(found), [0] * len(found)
            next_of: dict[str, int] = {}
            for j in range(len(found) - 1, -1, -1):
                self.after[j] = next_of.get(self.kind[j], len(found)) + 1
                next_of[self.kind[j]] = j
            return None
        j, seen, n = bisect.bisect_left(self.at, start), [], len(self.at)
        while j < n and not self.failed[j]:
            if self.kind[j] == ">":
                return self.at[j]
            seen.append(j)
            j = self.after[j]
        for k in seen:
            self.failed[k] = True
        return None


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag; comments and the like have an empty name."""
    ends, last, i = _Ends(page), page.rfind(">"), page.find("<")
    while i >= 0:
        end, name, closes, attributes = None, "", False, ""
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = end + 3 if end >= 0 else len(page)
        elif page[i : i + 9].upper() == "<![CDATA[":
            end = page.find("]]>", i + 9)
            end = end + 3 if end >= 0 else len(page)
        elif i < last:
            if page[i + 1] in "!?":
                end = page.find(">", i + 2) + 1
            elif m := _NAME.match(page, i + 1):
                name, closes = m[1].lower(), page[i + 1] == "/"
                if not closes and name in _RAW_END:
                    m = _RAW_END[name].search(page, page.find(">", i) + 1)
                    end, name = m.end() if m else len(page), ""
                else:
                    stop = ends.find(m.end())
                    if stop is not None:
                        end, attributes = stop + 1, page[m.end() : stop]
        if end is None or end == 0:
            i = page.find("<", i + 1)
        else:
            yield i, end, name, closes, attributes
            i = page.find("<", end)


def blocks(page: str) -> list[tuple[str, str, float]]:
    """(tag path, text, share of link text) of each leaf block in document order.

    A tag of the path carries its first class name, as in div.menu. Time and memory
    are in proportion to the page, whatever its markup; a ``<`` that begins no tag which ends is text.
    """
    out: list[tuple[str, str, float]] = []
    stack: list[str] = []
    names: list[str] = []
    where: dict[str, list[int]] = {}
    landmarks: list[int] = []
    text: list[str] = []
    path, linked, at = "", 0, 0

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            out.append((path, whole, min(1.0, linked / len(whole))))
        text.clear()
        linked = 0

    def here() -> str:
        if len(names) <= PATH_TAGS:
            return "/".join(names)
        above = bisect.bisect_left(landmarks, len(names) - PATH_TAGS)
        outer = [names[landmarks[above - 1]]] if above else []
        return "/".join(outer + names[-PATH_TAGS:])

    def add(raw: str) -> None:
        nonlocal path, linked
        if raw and not raw.isspace():
            if not text:
                path = here()
            raw = html.unescape(raw)
            if where.get("a"):
                linked += len(raw.strip())
        if raw:
            text.append(raw)

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def close(k: int) -> None:
        while len(stack) > k:
            where[stack.pop()].pop()
            names.pop()
        while landmarks and landmarks[-1] >= k:
            landmarks.pop()

    for start, end, tag, closes, attributes in _tags(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag not in _INLINE:
            flush()
        if closes:
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag in _VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in _CLOSES_P and where.get("p"):
            close(where["p"][-1])
        elif tag in _SELF_CLOSING:
            k = last(*_SELF_CLOSING[tag])
            if k >= 0 and k > last("ul", "ol", "table", "dl", "select"):
                close(k)
        if tag in _LANDMARKS:
            landmarks.append(len(stack))
        where.setdefault(tag, []).append(len(stack))
        stack.append(tag)
        names.append(f"{tag}.{c[1].lower()}" if (c := _CLASS.search(attributes)) else tag)
    add(page[at:])
    flush()
    return out


@lru_cache(maxsize=100_000)
def _bucket(token: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % dims, 1.0 if h & 0x10000 else -1.0


@lru_cache(maxsize=20_000)
def _path_vector(path: str, hide: bool) -> np.ndarray:
    v = np.zeros(PATH_DIMS)
    tags = path.split("/")
    if hide:
        tags = [t for t in (t.partition(".")[0] for t in tags) if t not in _LANDMARKS]
    for depth, tag in enumerate(reversed(tags)):
        i, sign = _bucket(f"t:{tag}", PATH_DIMS)
        v[i] += sign / (1 + depth / 2)
        if depth < 3:
            i, sign = _bucket(f"{depth}:{tag}", PATH_DIMS)
            v[i] += sign
    return (v / 2).astype(np.float32)


@lru_cache(maxsize=100_000)
def _word_code(word: str) -> int:
    i, sign = _bucket(word, WORD_DIMS)
    return i * 2 + (sign > 0)


def vectors(found: list[tuple[str, str, float]], hide: bool = False) -> np.ndarray:
    """One row for each block of a page."""
    x = np.zeros((len(found), INPUT), dtype=np.float32)
    codes: list[int] = []
    counts = np.zeros(len(found), dtype=np.int64)
    for k, (path, text, link_share) in enumerate(found):
        x[k, :PATH_DIMS] = _path_vector(path, hide)
        words = _WORD.findall(text.lower())
        codes.extend(map(_word_code, words))
        counts[k] = len(words)
        n = max(1, len(words))
        size = len(text)
        x[k, -OTHER_DIMS:] = (
            math.log1p(size) / 8, math.log1p(len(words)) / 6, link_share, (text.count(".") + text.count("!") + text.count("?")) / n,
            text[:1].isupper(), k / max(1, len(found) - 1), 1 / (1 + k), 1 / (len(found) - k),
        )
    own = np.array(codes, dtype=np.int64)
    at = np.repeat(np.arange(len(found)) * WORD_DIMS, counts) + (own >> 1)
    held = np.bincount(at, weights=(own & 1) * 2.0 - 1, minlength=len(found) * WORD_DIMS).reshape(-1, WORD_DIMS)
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = held / np.sqrt(np.maximum(counts, 1))[:, None]
    return x


def teach(paths: list[str]) -> np.ndarray:
    """1 content, 0 not, -1 unknown for each block of a page, by landmarks."""
    plain = [[t.partition(".")[0] for t in p.split("/")] for p in paths]
    has_main = any(_MAIN & set(tags) for tags in plain)
    out = np.full(len(paths), 0 if has_main else -1, dtype=np.int8)
    for k, tags in enumerate(plain):
        for tag in reversed(tags):
            if tag in _LANDMARKS:
                out[k] = tag in _MAIN
                break
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"out": rng.standard_normal(2 * HIDDEN) * 0.1, "bias": np.zeros(1)}
    for d in ("f", "b"):
        p[f"w{d}"] = rng.standard_normal((INPUT + HIDDEN, 4 * HIDDEN)) / np.sqrt(INPUT + HIDDEN)
        c = np.zeros(4 * HIDDEN)
        c[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        p[f"c{d}"] = c
    return {k: v.astype(np.float32) for k, v in p.items()}


def _read(x: np.ndarray, mask: np.ndarray, w: np.ndarray, c: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction; x is (time, pages, INPUT), mask (time, pages)."""
    steps, n = x.shape[:2]
    h, s = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out = np.empty((steps, n, HIDDEN), x.dtype)
    for first in range(0, steps, 2048):
        fed = x[first : first + 2048].reshape(-1, INPUT) @ w[:INPUT] + c
        fed = fed.reshape(-1, n, 4 * HIDDEN)
        for t in range(len(fed)):
            z = fed[t] + h @ w[INPUT:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[first + t][:, None]
            new = f * s + i * g
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((h, s, i, f, o, g, squashed, m))
            s = np.where(m, new, s)
            h = np.where(m, o * squashed, h)
            out[first + t] = h
    return out


def _unread(x: np.ndarray, dout: np.ndarray, w: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one direction's weights."""
    dw, dc = np.zeros_like(w), np.zeros_like(w[0])
    dh, ds = np.zeros(dout.shape[1:], w.dtype), np.zeros(dout.shape[1:], w.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, s, i, f, o, g, q, m = kept[t]
        dh = dh + dout[t]
        dn = (ds + dh * o * (1 - q * q)) * m
        dz = np.concatenate([dn * g * i * (1 - i), dn * s * f * (1 - f), dh * q * m * o * (1 - o), dn * i * (1 - g * g)], axis=1)
        dw[:INPUT] += x[t].T @ dz
        dw[INPUT:] += h.T @ dz
        dc += dz.sum(axis=0)
        dh = dz @ w[INPUT:].T + dh * (1 - m)
        ds = dn * f + ds * (1 - m)
    return dw, dc


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


def _flipped(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each page's own blocks in reverse order; the padding stays at the end."""
    n = mask.sum(axis=0)
    at = np.arange(len(x))[:, None]
    return np.take_along_axis(x, np.where(at < n, n - 1 - at, at)[:, :, None], axis=0)


def label(pages: list[np.ndarray], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Probability of content for each block of each page."""
    if not pages:
        return []
    x, mask = _padded(pages)
    forward = _read(x, mask, p["wf"], p["cf"])
    back = _flipped(_read(_flipped(x, mask), mask, p["wb"], p["cb"]), mask)
    y = _sigmoid(np.concatenate([forward, back], axis=2) @ p["out"] + p["bias"])
    return [y[: len(v), k] for k, v in enumerate(pages)]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the cross-entropy of known labels (1 or 0; -1 is unknown), both classes weighing one half."""
    kf, kb = [], []
    flipped = _flipped(x, mask)
    forward = _read(x, mask, p["wf"], p["cf"], kf)
    back = _flipped(_read(flipped, mask, p["wb"], p["cb"], kb), mask)
    both = np.concatenate([forward, back], axis=2)
    pos, neg = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg) * (y >= 0)
    d = ((_sigmoid(both @ p["out"] + p["bias"]) - y) * weight).astype(x.dtype)
    dboth = d[:, :, None] * p["out"]
    g = {"out": (both * d[:, :, None]).sum(axis=(0, 1)), "bias": d.sum(keepdims=True).reshape(1)}
    g["wf"], g["cf"] = _unread(x, dboth[:, :, :HIDDEN], p["wf"], kf)
    g["wb"], g["cb"] = _unread(flipped, _flipped(dboth[:, :, HIDDEN:], mask), p["wb"], kb)
    return g


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights from (vectors, teacher's labels) of each page, by Adam over whole sequences.

    All zero, so that every score is 0.5, where no page has a label.
    """
    p = initial(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    pieces = [(x[a : a + TRAIN_BLOCKS], y[a : a + TRAIN_BLOCKS]) for x, y in pages for a in range(0, len(x), TRAIN_BLOCKS)]
    pieces = [q for q in pieces if (q[1] >= 0).any()]
    if not pieces:
        return first
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for a in range(0, len(order), BATCH_PAGES):
            own = [pieces[k] for k in order[a : a + BATCH_PAGES]]
            x, mask = _padded([q[0] for q in own])
            y = np.full(mask.shape, -1, np.float32)
            for k, q in enumerate(own):
                y[: len(q[1]), k] = q[1]
            g = gradients(p, x, mask, y)
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k in p:
                v = g[k] * min(1.0, 1.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] = (p[k] - LEARNING_RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def examples(pages: list[str], hide_half: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for k, page in enumerate(pages):
        found = blocks(page)
        y = teach([b[0] for b in found])
        if (y >= 0).any():
            out.append((vectors(found, hide_half and k % 2 == 1), y))
    return out


def train(pages: DataFrame, bound: int = TRAIN_PAGES) -> dict[str, np.ndarray]:
    """Weights from at most ``bound`` pages."""
    own = pages.select(F.col("page_id").cast("long").alias("i"), F.col("html").cast("string").alias("h")).where("h is not null and h <> ''")
    ids = own.select("i").where("i is not null").orderBy(F.xxhash64("i"), "i").limit(bound)
    rows = own.join(F.broadcast(ids.distinct()), "i").groupBy("i").agg(F.min("h").alias("h")).orderBy("i").collect()
    return fit(examples([r.h for r in rows]))


_ROW = pa.schema([("page_id", pa.int64()), ("block", pa.int32()), ("tag_path", pa.string()), ("text", pa.string()), ("score", pa.float64()), ("content", pa.bool_())])


def _labelled(weights: dict[str, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), 256):
                found = [blocks(h) for h in pages[a : a + 256]]
                order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
                scores: dict[int, np.ndarray] = {}
                b = 0
                while b < len(order):
                    # Pages of like length are read together; a very long one by itself.
                    e = b + 1
                    while e < len(order) and e - b < 64 and len(found[order[e]]) * (e - b + 1) <= 20_000:
                        e += 1
                    own = order[b:e]
                    scores |= dict(zip(own, label([vectors(found[k]) for k in own], weights)))
                    b = e
                rows = [(ids[a + k], j, *block[:2], round(float(scores[k][j]), 4)) for k in range(len(found)) for j, block in enumerate(found[k])]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [s >= threshold for s in columns[4]]], _ROW.types)], schema=_ROW)

    return run


def label_blocks(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per block of each page row: page_id, block, tag_path, text, score, content.

    Blocks are numbered in document order; text has entities resolved and white
    space collapsed; scripts, styles and comments are no text. tag_path holds the innermost
    PATH_TAGS tags, class names their first 32 characters. A score that equals the threshold is content. Where no page
    of the sample has a landmark there is nothing to learn: every block scores 0.5.
    A null, empty or textless page has no row; broken markup is read as far as it goes,
    pages of any length whole. Repeated rows are labelled each for itself, a null page_id
    stays null, extra columns are ignored; an empty table gives no row.
    """
    weights = train(pages) if weights is None else weights
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("html is not null and html <> ''")
    return own.mapInArrow(_labelled(weights, threshold), "page_id long, block int, tag_path string, text string, score double, content boolean")


def extract_text(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page_id with content: page_id and its content blocks, one to a line, in document order.

    Pages without a content block (null, empty or textless ones too) have no row. Rows that
    repeat a page_id are one page: their blocks are put together by number, then by text; so are those of all null page_ids.
    """
    own = label_blocks(pages, weights, threshold).where("content")
    lines = F.sort_array(F.collect_list(F.struct("block", "text")))
    return own.groupBy("page_id").agg(F.array_join(F.transform(lines, lambda b: b["text"]), "\n").alias("text"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_blocks(read(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
SQL: dict[str, str] = {}
