"""Helpers the text operators share: Arrow text chunks and vectorised word hashing (stage tables come
from ``tagweave.session``).

Inside a task, texts are handled as UTF-8 bytes in chunks of bounded size, so a
task's Python memory follows the chunk (or one document), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged as staged

CHUNK_BYTES = 1 << 20


def unchanged_schema(df: DataFrame, extra: str) -> str:
    """A name for a helper column that clashes with none of ``df``'s."""
    while extra in df.columns:
        extra = "_" + extra
    return extra


# ---------------------------------------------------------------- Arrow batches

def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def text_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts sum to ``limit`` bytes at most (or one longer text)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


# ---------------------------------------------------------------- words

def _table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, on UTF-8 bytes
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
# [^\x20\x09-\x0D]+
NON_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint64) + np.uint64(1)
EXACT = np.arange(1, 257, dtype=np.uint64)

# byte map for bytes.translate(): separators to blank, A-Z to a-z
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if ALNUM[b] else 0x20 for b in range(256))

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS = {"n": 0}


def fold_words(text: bytes) -> list[bytes]:
    """The lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of one text."""
    return text.translate(_FOLD).split()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        n = max(n, 2 * CHUNK_BYTES)
        for key, base in (("p", _P), ("i", _P_INV)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
        _POWERS["n"] = n
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """Words of a chunk of texts: ``doc`` (index in the chunk), ``start``/``end`` (bytes in ``buf``)
    and ``hash``; ``first[d]`` is the index of document d's first word, ``base[d]`` its first byte."""

    __slots__ = ("base", "buf", "count", "doc", "end", "first", "hash", "start")


def words(texts: list[bytes], is_word: np.ndarray = ALNUM, value: np.ndarray = LOWER) -> Words:
    w = Words()
    w.buf = buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    w.base = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    flags = is_word[buf]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if len(flags) and flags[0]:
        edges = np.concatenate(([0], edges))
    w.start, w.end = edges[0::2], edges[1::2]
    power, inverse = powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(value[buf] * power[:len(buf)], out=sums[1:])
    h = (sums[w.end] - sums[w.start]) * inverse[w.start]
    w.hash = mix(h + (w.end - w.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    w.first = np.searchsorted(w.start, w.base)
    bounds = np.append(w.first, len(w.start))
    w.count = np.diff(bounds)
    w.doc = np.repeat(np.arange(len(texts)), w.count)
    return w


def grams(w: Words, n: int, seed: int = 0x2545F4914F6CDD1D) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside one document, and the index of each one's first word."""
    if len(w.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w.hash) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    factor = np.uint64(seed | 1)
    for j in range(n):
        out *= factor
        out += w.hash[j:j + m]
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1:])
    return mix(out[at]), at


def long_hash(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_frame(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, text, ...) only: column pruning reaches the scan, other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *extra)
