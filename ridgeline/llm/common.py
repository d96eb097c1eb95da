"""What the text operators share: folding text to words, hashing.

Text is folded one character at a time: compatibility decomposition, marks and
invisible format characters (soft hyphens, zero-width spaces) dropped, lower case,
everything that is not a letter or digit becomes a space, and runs of spaces shrink
to one. A character of a script written without spaces is a word of its own. As every character is folded by itself, the
folded text can be traced back to the original character by character.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ridgeline.checkpoints import cut  # noqa: F401

_ASCII = bytes(
    (b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() else 32) if b < 128 else b for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Han, kana, Bopomofo, Thai, Lao, Myanmar and Khmer: ranges of code points of scripts written without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u3029\u3040-\u312f\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


@lru_cache(maxsize=200_000)
def fold_char(c: str) -> str:
    """What one character becomes; '' for a combining mark or a format character, ' ' for a separator."""
    out = []
    for d in unicodedata.normalize("NFKD", c):
        if unicodedata.category(d)[0] == "M" or unicodedata.category(d) == "Cf":
            continue
        for e in unicodedata.normalize("NFKD", d.lower()):
            if unicodedata.category(e)[0] != "M":
                out.append((f" {e} " if _UNSPACED.match(e) else e) if e.isalnum() else " ")
    return "".join(out)


class _Table(dict):
    """A translation table that is filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        out = self[code] = fold_char(chr(code))
        return out


#: Bounded by the number of Unicode characters.
_FOLDED = _Table({c: chr(c) for c in range(128)})


def fold(text: str) -> str:
    """Folded words of a text, joined by single spaces; '' if it has no word."""
    if not text.isascii():
        others = [c for c in set(text) if c > "\x7f"]
        if len(others) > 40:
            text = text.translate(_FOLDED)
        else:
            for c in others:
                text = text.replace(c, fold_char(c))
    return " ".join(text.encode("utf-8", "replace").translate(_ASCII).decode("utf-8").split())


def fold_with_offsets(text: str) -> tuple[str, np.ndarray]:
    """``fold(text)`` and, for each of its characters, the index in ``text`` it came from."""
    chars: list[str] = []
    at: list[int] = []
    gap = -1
    for i, c in enumerate(text):
        folded = fold_char(c)
        for d in folded:
            if d == " ":
                gap = i if chars and gap < 0 else gap
            else:
                if gap >= 0:
                    chars.append(" ")
                    at.append(gap)
                    gap = -1
                chars.append(d)
                at.append(i)
    return "".join(chars), np.array(at, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept between calls."""
    if len(_POW.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["up"], _POW["down"]


def word_hashes(folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some folded texts, and how many words each text has.

    One pass of array arithmetic: prefix sums of a polynomial hash give every
    word's value without splitting the text.
    """
    buf = np.frombuffer((" ".join(folded) + " ").encode("utf-8"), dtype=np.uint8)
    up, down = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=prefix[1:])
    spaces = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], spaces[:-1] + 1)) if len(spaces) else np.zeros(0, dtype=np.int64)
    ends = spaces
    # An empty text leaves one empty word between two separators.
    counts = np.array([t.count(" ") + 1 if t else 0 for t in folded], dtype=np.int64)
    real = ends > starts
    starts, ends = starts[real], ends[real]
    return mix64((prefix[ends] - prefix[starts]) * down[starts]), counts


def chunks_by_size(sizes: list[int], limit: int):
    """Ranges of consecutive items whose sizes add up to about ``limit``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
