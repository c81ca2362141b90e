"""Phrase collocation mining: multikey three-way quicksort of suffix pointers.

A suffix pointer is the place of a word; its keys are that word and the next ones up to the maximum depth
(phrase length), cut at the end of its piece.  Sorting pointers key by key into less, equal and greater
makes every equal partition of depth d one phrase of d words, and its size the phrase's count.

First, pointers are routed globally by their two leading words: each chunk's equal partitions of depth 2
meet under a 40-bit hash of (lang, two words) and are added up.  A sum under ``least`` proves every phrase
that starts there infrequent, so it is abandoned; the others are kept as a bitmap of fixed size
(``map_bits`` at most), which is all that the next pass is sent.  Second, every chunk sorts the pointers
whose leading pair was kept, to the maximum depth, abandoning a partition whose further words hold a
pair that was not; partition sizes are added up by an aggregate with map-side combine, and the bitmap's
false guesses go by the exact sums.  A hot word or pair is one partial row per task, and there is no join on
words of the text.

All scores are exact: counts are longs and quotients are taken in decimals.  Words meet as 64-bit
fingerprints (two of n words share one with probability n^2 / 2^65).

Defined results: null text is empty, null lang is ``und``; bytes A-Z are lower-cased, nothing else; ties of a
cut go to the shorter first part, of a rank to the larger count, then the smaller phrase (UTF-8 bytes);
repeated rows count again; an empty table has no phrases; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, Words, byte_texts, mix, staged, text_chunks, words

DEPTH = 4
LEAST = 30
TOP = 2000
KEY_BITS = 40
MAP_BITS = 30  # the largest bitmap of leading pairs: 2^30 bits, 128 MiB

_ENDS = b".,;:!?\n\x0b\x0c\r"
_WORD = np.array([b not in b" \t" + _ENDS for b in range(256)])
_END = np.array([b in _ENDS for b in range(256)])
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


# ---------------------------------------------------------------- suffix pointers

def _cuts(text: bytes) -> list[bytes]:
    """A long text in parts that end at piece ends, so that a task's memory follows the chunk."""
    out, lo = [], 0
    while len(text) - lo > 2 * CHUNK_BYTES:
        hi = max(text.rfind(bytes([b]), lo, lo + CHUNK_BYTES) for b in _ENDS) + 1
        if hi <= lo:
            break
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], Words]]:
    """(lang number of each text, langs, words) of chunks of a batch of (lang, text)."""
    langs, number, of = [], {}, []
    texts = []
    for lang, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
        k = number.setdefault(lang, len(number))
        if k == len(langs):
            langs.append(lang)
        for part in _cuts(text):
            texts.append(part)
            of.append(k)
    of = np.array(of, np.int64)
    for lo, hi in text_chunks(texts):
        yield of[lo:hi], langs, words(texts[lo:hi], _WORD, LOWER)


def pointers(w: Words, depth: int) -> np.ndarray:
    """One row per word: the hashes of it and of the next ones of its piece; 0 beyond the piece's end."""
    n = len(w.hash)
    piece = np.cumsum(_END[w.buf])[w.start] if n else np.zeros(0, np.int64)
    keys = np.zeros((n, depth), np.uint64)
    for d in range(depth):
        if n > d:
            same = (w.doc[:n - d] == w.doc[d:]) & (piece[:n - d] == piece[d:])
            keys[:n - d, d] = np.where(same, w.hash[d:], 0)
    return keys


def quicksort(keys: np.ndarray, lang: np.ndarray, keep=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers: for d = 1, 2, ... (d, first pointer, size) of every equal
    partition of d keys.  All partitions of a depth are split together, each by a pivot of its own.

    ``lang`` is the key before the first.  ``keep(d, first pointers)``, if given, tells which partitions go on.
    """
    at = np.argsort(lang, kind="stable")
    bounds = np.flatnonzero(np.diff(lang[at])) + 1
    size = np.diff(np.concatenate(([0], bounds, [len(at)]))) if len(at) else np.zeros(0, np.int64)
    for d in range(keys.shape[1]):
        column = keys[:, d]
        live = column[at] != 0  # pointers whose piece ends here have no such phrase
        part = np.repeat(np.arange(len(size)), size)[live]
        at = at[live]
        size = np.bincount(part, minlength=len(size))
        size = size[size > 0]
        at, size = _split(at, size, column)
        if not len(at):
            return
        first = at[np.cumsum(size) - size]
        yield d + 1, first, size
        if keep is not None and d + 1 < keys.shape[1]:
            on = keep(d + 1, first)
            at, size = at[np.repeat(on, size)], size[on]


def _split(at: np.ndarray, size: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split partitions (``at`` in order, by ``size``) until each holds one value of ``column``."""
    n = len(at)
    at = at.copy()
    head = np.zeros(n + 1, bool)  # where a partition of equal values starts
    lo = np.cumsum(size) - size
    while len(lo):
        head[lo] = True
        one = size == 1
        lo, size = lo[~one], size[~one]
        if not len(lo):
            break
        # places of the open partitions, end to end
        total = int(size.sum())
        offset = np.cumsum(size) - size
        part = np.repeat(np.arange(len(lo)), size)
        place = np.arange(total) - offset[part] + lo[part]
        value = column[at[place]]
        a, b, c = (value[offset + (size - 1) * i // 2] for i in range(3))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]  # the median of three
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        counts = np.bincount(part * 3 + side, minlength=3 * len(lo)).reshape(-1, 3)
        # stable three-way partition: rank of each element among its partition's less, equal or greater ones
        start = lo[:, None] + np.cumsum(counts, 1) - counts
        target = np.empty(total, np.int64)
        for s in range(3):
            own = np.flatnonzero(side == s)
            before = np.cumsum(counts[:, s]) - counts[:, s]
            target[own] = np.arange(len(own)) - before[part[own]] + start[part[own], s]
        moved = at[place]
        at[target] = moved
        head[start[counts[:, 1] > 0, 1]] = True
        keep = np.concatenate([counts[:, 0], counts[:, 2]]) > 0
        lo, size = np.concatenate([start[:, 0], start[:, 2]])[keep], np.concatenate([counts[:, 0], counts[:, 2]])[keep]
    edges = np.flatnonzero(head[:n])
    return at, np.diff(np.append(edges, n))


# ---------------------------------------------------------------- passes over the texts

def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def _lang_salt(langs: list[str]) -> np.ndarray:
    """A hash for each lang, the same in every task."""
    return np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in langs], np.uint64)


def _pair_keys(lang_hash: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(lang_hash + a * np.uint64(0x9E3779B97F4A7C15) + mix(b)) >> np.uint64(64 - KEY_BITS)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, h, c): each chunk's distinct words."""
    for batch in batches:
        for of, langs, w in _chunks(batch):
            out: tuple[list, list, list, list] = ([], [], [], [])
            keys = pointers(w, 1)
            for _, first, size in quicksort(keys, of[w.doc]):
                buf = w.buf.tobytes()
                out[0].extend(langs[k] for k in of[w.doc[first]])
                out[1].extend(buf[s:e].translate(_FOLD).decode() for s, e in zip(w.start[first], w.end[first]))
                out[2].extend(w.hash[first].view(np.int64).tolist())
                out[3].extend(size.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()),
                                              pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                                             names=["lang", "word", "h", "c"])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, c): each chunk's equal partitions of two leading words, under their hash."""
    for batch in batches:
        for of, langs, w in _chunks(batch):
            keys, salt = pointers(w, 2), _lang_salt(langs)
            for d, first, size in quicksort(keys, of[w.doc]):
                if d == 2:
                    k = _pair_keys(salt[of[w.doc[first]]], keys[first, 0], keys[first, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(size)], names=["pair", "c"])


def _phrase_rows(kept: np.ndarray, bits: int, depth: int):
    """(lang, h, c): each chunk's equal partitions of 2 to ``depth`` words among the pointers that are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, langs, w in _chunks(batch):
                keys, salt = pointers(w, depth), _lang_salt(langs)
                lang = of[w.doc]
                at = np.flatnonzero(keys[:, 1]) if len(keys) else np.zeros(0, np.int64)
                pair = np.zeros(len(keys) + depth, bool)  # does the pair at this pointer pass?
                k = _pair_keys(salt[lang[at]], keys[at, 0], keys[at, 1]) >> np.uint64(KEY_BITS - bits)
                pair[at] = (kept[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1
                start = np.flatnonzero(pair[:len(keys)])
                own = keys[start]
                for d in range(2, depth):  # a word beyond a pair that was not kept ends the pointer
                    own[~pair[start + d - 1], d:] = 0
                for d, first, size in quicksort(own, lang[start]):
                    if d > 1:
                        h = np.zeros((len(first), depth), np.uint64)
                        h[:, :d] = own[first, :d]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([langs[x] for x in lang[start[first]]], pa.string()),
                             *[pa.array(np.ascontiguousarray(h[:, j]).view(np.int64)) for j in range(depth)],
                             pa.array(size, pa.int64())], names=["lang", *[f"h{j}" for j in range(depth)], "c"])
    return run


def _bitmap(bits: int, low: int):
    """One segment of the bitmap: keys that share their upper bits, as bytes."""
    def run(t: pa.Table) -> pa.Table:
        k = t.column("pair").to_numpy().astype(np.uint64) >> np.uint64(KEY_BITS - bits)
        seg = np.zeros(1 << max(0, low - 3), np.uint8)
        at = (k & np.uint64((1 << low) - 1)).astype(np.int64)
        np.bitwise_or.at(seg, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"segment": [int(k[0] >> np.uint64(low))], "bits": [seg.tobytes()]},
                        schema=pa.schema([("segment", pa.int64()), ("bits", pa.binary())]))
    return run


def kept_pairs(base: DataFrame, least: int, map_bits: int) -> tuple[np.ndarray, int]:
    """(bitmap, bits) of the leading pairs whose hash was met ``least`` times or more.  The bitmap has 16 bits
    for each of them, within 2^``map_bits``, and is built in segments of 2^16 bits."""
    pairs = staged(base.mapInArrow(_pair_rows, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
                   .where(F.col("c") >= least).select("pair"), "collocation-pairs")
    n = pairs.count()
    bits = min(map_bits, KEY_BITS, max(16, int(np.ceil(np.log2(16 * max(n, 1))))))
    low = min(16, bits)
    out = np.zeros(1 << (bits - 3), np.uint8)
    segments = pairs.groupBy(F.shiftrightunsigned("pair", KEY_BITS - bits + low).alias("at")) \
        .applyInArrow(_bitmap(bits, low), "segment long, bits binary")
    for segment, b in segments.toLocalIterator():
        out[segment << (low - 3):(segment + 1) << (low - 3)] = np.frombuffer(b, np.uint8)
    return out, bits


# ---------------------------------------------------------------- phrases and scores

def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, map_bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(words: lang, word, h, f of every word; phrases: lang, h array, f of every phrase of 2 to ``depth`` words
    with f >= ``least``), both written tables."""
    base = _base(docs)
    vocabulary = staged(base.mapInArrow(_word_rows, "lang string, word string, h long, c long")
                        .groupBy("lang", "word", "h").agg(F.sum("c").alias("f")), "collocation-words")
    kept, bits = kept_pairs(base, least, map_bits)
    hs = [f"h{j}" for j in range(depth)]
    schema = "lang string, " + ", ".join(f"{h} long" for h in hs) + ", c long"
    counted = base.mapInArrow(_phrase_rows(kept, bits, depth), schema).groupBy("lang", *hs).agg(F.sum("c").alias("f")) \
        .where(F.col("f") >= least)
    phrases = staged(counted.select("lang", F.filter(F.array(*hs), lambda x: x != 0).alias("h"), "f"), "collocation-phrases")
    return vocabulary, phrases


def scored(vocabulary: DataFrame, phrases: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, h, a, l, r, k, score): every phrase's lowest-scoring cut."""
    counts = vocabulary.where(F.col("f") >= least).select("lang", F.array("h").alias("h"), "f").unionByName(phrases)
    cut = F.explode(F.sequence(F.lit(1), F.size("h") - 1)).alias("k")
    cuts = phrases.select("lang", "h", F.col("f").alias("a"), cut)
    one = lambda c: counts.select(F.col("lang").alias(f"lang_{c}"), F.col("h").alias(f"h_{c}"), F.col("f").alias(c))
    left = cuts.join(one("l"), (F.col("lang") == F.col("lang_l")) & (F.slice("h", F.lit(1), F.col("k")) == F.col("h_l")))
    both = left.join(one("r"), (F.col("lang") == F.col("lang_r"))
                     & (F.slice("h", F.col("k") + 1, F.size("h") - F.col("k")) == F.col("h_r")))
    score = F.expr("(2000000BD * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    return both.withColumn("score", score.cast("long")).groupBy("lang", "h", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "h", "a", "cut.*")


def uncovered(phrases: DataFrame, share: int = 80) -> DataFrame:
    """``phrases`` less those inside a longer one that is at least ``share`` hundredths as frequent."""
    inner = F.explode(F.filter(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("h") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.size("h") - n + 1), lambda i: F.slice(F.col("h"), i, n)))), lambda x: F.size(x) > 1))
    longest = phrases.where(F.size("h") > 2).select(F.col("lang").alias("lang_in"), inner.alias("h_in"), "f") \
        .groupBy("lang_in", "h_in").agg(F.max("f").alias("longer"))
    return phrases.join(longest, (F.col("lang") == F.col("lang_in")) & (F.col("h") == F.col("h_in")), "left") \
        .where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100
                                           < F.col("f").cast("decimal(20,0)") * share)).select("lang", "h", "f")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP,
                 map_bits: int = MAP_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top`` phrases."""
    vocabulary, phrases = phrase_counts(docs, depth, least, map_bits)
    kept = uncovered(phrases).select(F.col("lang").alias("lang_k"), F.col("h").alias("h_k"))
    best = scored(vocabulary, phrases, least).join(kept, (F.col("lang") == F.col("lang_k")) & (F.col("h") == F.col("h_k"))) \
        .select("lang", "h", "a", "l", "r", "score")
    # texts of the words: one row per word of a phrase
    spelled = best.select("*", F.posexplode("h").alias("i", "x")).join(
        vocabulary.where(F.col("f") >= least).select(F.col("lang").alias("lang_w"), F.col("h").alias("h_w"), "word"),
        (F.col("lang") == F.col("lang_w")) & (F.col("x") == F.col("h_w"))) \
        .groupBy("lang", "h", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w")) \
        .withColumn("phrase", F.array_join("w.word", " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = spelled.withColumn("rank", rank).where(F.col("rank") <= top)
    n = vocabulary.groupBy(F.col("lang").alias("lang_n")).agg(F.sum("f").alias("n"))
    return ranked.join(n, F.col("lang") == F.col("lang_n")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs)
