"""Token ids of a public byte-level vocabulary, read from a file whose path is a parameter."""

from __future__ import annotations

import base64
import re
from itertools import chain

import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space too long for the splitter, which looks ahead from each of their characters. White space as it knows it, not as Python does.
LONG_RUN = 1000
_LONG = re.compile(r"[\t-\r \x85\xa0  -     　]{%d,}" % LONG_RUN)

_LOADED: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The vocabulary at a path; loaded once in each worker."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        _LOADED[path] = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def end_mark(path: str = VOCABULARY) -> int:
    """The id that stands for the end of a text: the one after the vocabulary's last."""
    return encoding(path).max_token_value + 1


def pieces(enc: tiktoken.Encoding, text: str):
    """The ids of a text, in lists: those of ``enc.encode_ordinary`` for texts of any length and make-up.

    A run of white space is one piece up to its last character, which goes with what
    follows; at the end of the text it is one piece whole. So long runs can be cut out and merged by themselves.
    """
    at = 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield enc.encode_ordinary(text[at : m.start()])
        yield enc._encode_single_piece(text[m.start() : end])
        at = end
    if at < len(text):
        yield enc.encode_ordinary(text[at:])


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    return list(chain.from_iterable(pieces(enc, text)))


def count_column(text: Column, path: str = VOCABULARY) -> Column:
    """How many tokens a text has; 0 for null."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([sum(map(len, pieces(enc, t))) if t else 0 for t in texts.to_pylist()], pa.int32())

    return count(text.cast("string"))
