"""Substring de-duplication: documents are parsed into factors copied from earlier text, long ones go.

The reference is the whole corpus, spread over blocks by hash.  No block's text is compared with another's:
longest matches are found through hashes, as a passage that a third of all documents hold would
otherwise meet its copies text by text.

1. A window of 20 words has one anchor: the 8-word gram of least hash in it (leftmost on ties), the same
   wherever the window stands.  Consecutive windows of one anchor form a piece with its context, the
   words from the first window's start to the last one's end.  Pieces tile a document's windows.
2. The blocks index pieces by anchor; anchors that stand once in the corpus are dropped.
3. A piece whose anchor and whole context stand earlier is copied from the earliest such place: all its
   windows are duplicates.
4. A match ends where the contexts of one anchor differ.  There, and only there (the first piece
   of each different context of an anchor), windows are checked one by one: 128-bit window hashes,
   earliest place.
5. A document's copied pieces and windows, from left to right, are parsed into factors: a factor takes the
   next windows for as long as their source goes on at the same offset of the same document.  Every
   factor is at least a window long; its words are cut.

Windows are judged on the input: a word goes if a window that covers it also starts earlier, in a
smaller doc_id or earlier in the document.

Scale: pieces are about a seventh of the words and cross the shuffle as four numbers each; the corpus's
text is shuffled once (spans meet texts by doc_id); a hot passage is met in aggregates with map-side
combine and in plain equi-joins that adaptive execution splits.

Defined results: null or empty text has no words and stays as it is; texts shorter than a window are
kept whole; null doc_id comes after every other, and rows that repeat a doc_id are ordered by their text
(equal rows: all but one are later copies); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EXACT, NON_SPACE, Words, byte_texts, mix, staged, text_chunks, text_frame, words

WINDOW = 20
GRAM = 8


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of g[i:i + width] for every i, leftmost on ties; by doubling."""
    at = np.arange(len(g))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        have += step
    return at


def _gram_hashes(w: Words, n: int, seed: int) -> np.ndarray:
    m = len(w.hash) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    factor = np.uint64(seed | 1)
    for j in range(n):
        out *= factor
        out += w.hash[j:j + m]
    return mix(out)


_Q = 0xD1342543DE82EF95 | 1
_Q_INV = pow(_Q, -1, 1 << 64)


def pieces(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """(document, anchor, context, first window, number of windows) of every piece of a chunk."""
    w = words(texts, NON_SPACE, EXACT)
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none
    starts = n - window + 1
    g = _gram_hashes(w, gram, 0x2545F4914F6CDD1D)
    at = _least(g, window - gram + 1)[:starts]
    ok = w.doc[:starts] == w.doc[window - 1:]
    p = np.flatnonzero(ok)
    if not len(p):
        return none, none, none, none, none
    new = np.concatenate(([True], (at[p][1:] != at[p][:-1]) | (np.diff(p) != 1)))
    lo = p[new]
    count = np.diff(np.append(np.flatnonzero(new), len(p)))
    hi = lo + count + window - 1  # end of the context, in words
    one = np.ones(1, np.uint64)
    power = np.multiply.accumulate(np.concatenate((one, np.full(n, _Q, np.uint64))))
    back = np.multiply.accumulate(np.concatenate((one, np.full(n, _Q_INV, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash * power[:n])))
    anchor = at[lo]
    context = mix((sums[hi] - sums[lo]) * back[lo] + (anchor - lo).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
                  + count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    d = w.doc[lo]
    return d, g[anchor].view(np.int64), context.view(np.int64), lo - w.first[d], count


def window_hashes(text: bytes, runs: list[tuple[int, int]], window: int = WINDOW):
    """(h1, h2, start) of the windows start .. start + n - 1 of each (start, n)."""
    w = words([text], NON_SPACE, EXACT)
    at = np.unique(np.concatenate([np.arange(a, a + n) for a, n in runs]))
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = np.zeros(len(at), np.uint64)
        for j in range(window):
            h = h * np.uint64(seed | 1) + w.hash[at + j]
        out.append(mix(h ^ np.uint64(seed)).view(np.int64))
    return out[0], out[1], at


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), byte_texts(batch.column(1))
        for lo, hi in text_chunks(texts):
            d, anchor, context, first, n = pieces(texts[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(context), pa.array(ids[lo:hi][d].astype(np.int64)),
                 pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["anchor", "context", "doc", "first", "n"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, runs in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist()):
            h1, h2, at = window_hashes(text, [(r["first"], r["n"]) for r in runs])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), pa.array(np.full(len(at), doc, np.int64)), pa.array(at.astype(np.int32))],
                names=["h1", "h2", "doc", "first"])


def _place(doc: str = "doc", first: str = "first"):
    """(doc, first word) as one ordered number: aggregates over it stay hash aggregates."""
    return (F.col(doc).cast("decimal(20,0)") * F.lit(2 ** 31).cast("decimal(11,0)") + F.col(first)).cast("decimal(38,0)")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text), doc unique and in doc_id order.  Usually doc is doc_id; where ids are null or
    repeat, rows are numbered in (doc_id, text) order."""
    base = text_frame(docs)
    rows, ids, known = base.agg(F.count("*"), F.countDistinct("doc_id"), F.count("doc_id")).first()
    if rows == ids == known:
        return base.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    ordered = base.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return staged(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "substring-docs")


def _copied(rows: DataFrame, last) -> DataFrame:
    """(doc, first, last, source, source_first) of rows that start after their ``place``."""
    word = F.pmod(F.col("place"), F.lit(2 ** 31).cast("decimal(11,0)"))
    found = rows.where(_place() > F.col("place")).select("doc", "first", last.cast("int").alias("last"), "place", word.alias("word"))
    return found.select("doc", "first", "last", F.expr("(place - word) div 2147483648").alias("source"),
                        F.col("word").cast("int").alias("source_first"))


def duplicate_spans(texts: DataFrame) -> DataFrame:
    """``texts``: (doc, text).  (doc, first, last, source, source_first): word spans whose windows all start
    earlier too, and the earliest place of the same words."""
    found = texts.mapInArrow(_piece_rows, "anchor long, context long, doc long, first int, n int")
    # written tables: a join with them deals out both sides anew, so adaptive execution can split a hot anchor
    again = staged(found.groupBy("anchor").count().where("count > 1").select("anchor"), "substring-anchors")
    shared = staged(found.join(again, "anchor"), "substring-pieces")

    contexts = staged(shared.groupBy("anchor", "context").agg(F.min(_place()).alias("place")), "substring-contexts")
    placed = shared.join(contexts, ["anchor", "context"])
    copied = _copied(placed, F.col("first") + F.col("n") + (WINDOW - 2))

    differing = staged(shared.groupBy("anchor").agg(F.min("context").alias("lo"), F.max("context").alias("hi"))
                       .where("lo != hi").select("anchor"), "substring-differing")
    ends = placed.where(_place() == F.col("place")).join(differing, "anchor", "left_semi")
    runs = ends.groupBy("doc").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    windows = staged(texts.join(runs, "doc").select("doc", "text", "runs").mapInArrow(
        _window_rows, "h1 long, h2 long, doc long, first int"), "substring-windows")
    earliest = staged(windows.groupBy("h1", "h2").agg(F.min(_place()).alias("place"), F.count("*").alias("n"))
                      .where("n > 1").select("h1", "h2", "place"), "substring-earliest")
    return copied.unionByName(_copied(windows.join(earliest, ["h1", "h2"]), F.col("first") + (WINDOW - 1)))


def factors(spans: list[dict], window: int = WINDOW) -> list[dict]:
    """Spans of one document to factors: the next windows join the factor if they continue its source."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        f = out[-1] if out else None
        if f and s["first"] <= f["last"] - window + 2 and s["source"] == f["source"] \
                and s["source_first"] - s["first"] == f["source_first"] - f["first"]:
            f["last"] = max(f["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digest, spanned, copied = [], [], [], [], []
        for text, spans in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist()):
            ws = text.split()
            parsed = factors(spans or [])
            merged = merge([(f["first"], f["last"]) for f in parsed])
            left, at = [], 0
            for a, b in merged:
                left += ws[at:a]
                at = b + 1
            left += ws[at:]
            total.append(len(ws))
            removed.append(len(ws) - len(left))
            digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            spanned.append([{"first": a, "last": b} for a, b in merged])
            copied.append(parsed)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
             pa.array(spanned, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
             pa.array(copied, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("source", pa.int64()),
                                                  ("source_first", pa.int32())])))],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors"])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the removed word spans of every document and the factors they
    are made of; ``source`` is a doc_id (a row number in (doc_id, text) order where ids are null or repeat)."""
    rows = keyed(docs)
    spans = duplicate_spans(rows.select("doc", "text")).groupBy("doc").agg(
        F.collect_list(F.struct("first", "last", "source", "source_first")).alias("spans"))
    return rows.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        _cut_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>, "
                   "factors array<struct<first:int,last:int,source:long,source_first:int>>")
