"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Items are lower-cased, cut into words and into windows of ``window`` consecutive words (an item
shorter than that, but not empty, is one window).  Every distinct item word becomes one symbol, so a
window is a short symbol string and the automaton's size follows the benchmark's words, not its
characters.  A document is scanned once: its words are mapped to symbols (any other word breaks a
match), the automaton reports each window's end, and word offsets are mapped back to bytes of the
original text.

Scale: a map over documents, no shuffle.  The automaton's items are broadcast only up to
``max_bytes`` of text; a larger benchmark is hashed by item into parts of that size, the documents' own
texts are scanned once per part, each part's findings are written and its broadcast released before the
next one, and the findings are united per document: the results do not depend on the parts.

Defined results: null or empty text has no words and is clean; items with null id or without words
take no part; repeated items count once per id; repeated documents are each returned; other columns
are ignored.  No benchmark: every document is clean.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, fold_words, staged, text_frame, unchanged_schema, words

WINDOW = 10
MAX_BYTES = 16 << 20
_GAP = "\x01"
_BUILT: dict[str, tuple] = {}

FOUND = "item_ids array<string>, hits array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>"


def _symbol(i: int) -> str:
    """The i-th symbol: code points from 2 on, without the surrogates."""
    i += 2
    return chr(i if i < 0xD800 else i + 0x800)


def build(items: list[tuple[int, bytes]], window: int):
    """(automaton, word -> symbol): each window's payload is (its length, ids of its items)."""
    symbols: dict[bytes, str] = {}
    owners: dict[str, set[int]] = {}
    for item, text in items:
        ws = fold_words(text)
        if not ws:
            continue
        line = "".join(symbols.setdefault(w, _symbol(len(symbols))) for w in ws)
        for i in range(max(1, len(line) - window + 1)):
            owners.setdefault(line[i:i + window], set()).add(item)
    auto = ahocorasick.Automaton()
    for key, ids in owners.items():
        auto.add_word(key, (len(key), frozenset(ids)))
    if owners:
        auto.make_automaton()
    return (auto if owners else None), symbols


def item_parts(benchmark: DataFrame, max_bytes: int) -> list[DataFrame]:
    """The items in parts of about ``max_bytes`` of text each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // max_bytes) or 1
    return [items] if parts == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) for i in range(parts)]


def sent(items: DataFrame) -> tuple:
    """One part as a broadcast with a name."""
    rows = [(r[0], r[1].encode()) for r in items.collect()]
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(rows)


def built(part: tuple, window: int) -> tuple:
    """The automaton of one broadcast, built once per Python worker."""
    name, items = part
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build(items.value, window)
    return _BUILT[name]


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of each word of the original text."""
    w = words([text])
    return list(zip(w.start.tolist(), w.end.tolist()))


def scan(auto, symbols: dict[bytes, str], ws: list[bytes]) -> tuple[set[int], list[tuple[int, int]]]:
    """Items whose windows occur, and the merged runs (first, last word) that they cover."""
    ids: set[int] = set()
    runs: list[list[int]] = []
    if auto is None or not ws:
        return ids, []
    get = symbols.get
    for end, (n, owners) in auto.iter("".join([get(x, _GAP) for x in ws])):
        ids |= owners
        first = end - n + 1
        while runs and runs[-1][0] >= first:
            runs.pop()
        if runs and runs[-1][1] >= first - 1:
            runs[-1][1] = end
        else:
            runs.append([first, end])
    return ids, [tuple(r) for r in runs]


def _findings(part, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, symbols = built(part, window)
        for batch in batches:
            n, ids, hits, spans = [], [], [], []
            for text in byte_texts(batch.column(1)):
                ws = fold_words(text)
                found, runs = scan(auto, symbols, ws)
                n.append(len(ws))
                ids.append(sorted(map(str, found)))
                hits.append([{"first": a, "last": b} for a, b in runs])
                at = word_offsets(text) if runs else []
                spans.append([{"start": at[a][0], "end": at[b][1]} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.string())),
                 pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "item_ids", "hits", "spans"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, item_ids (sorted strings), hits (runs of word
    indexes, from 0), spans (the same runs as byte offsets in the original text)."""
    parts = item_parts(benchmark, max_bytes)
    if len(parts) == 1:
        return text_frame(docs).mapInArrow(_findings(sent(parts[0]), window), f"doc_id long, n_words long, {FOUND}")
    # beyond the bound: scan part by part, each row under a key of its own, and unite the runs
    rows = staged(text_frame(docs).withColumn("row", F.monotonically_increasing_id()), "decontaminate-docs")
    joined = _united(rows.select("row", "text"), parts, window)
    return rows.select("row", "doc_id").join(joined, "row").select("doc_id", "n_words", "item_ids", "hits", "spans")


def _united(rows: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """(row, n_words, item_ids, hits, spans) of ``rows`` (row, text) over all parts: runs that overlap or follow
    one another are one run, as within a part."""
    every = None
    for items in parts:
        part = sent(items)
        one = staged(rows.mapInArrow(_findings(part, window), f"doc_id long, n_words long, {FOUND}"), "decontaminate-part")
        part[1].destroy()
        every = one if every is None else every.unionByName(one)
    run = F.transform(F.arrays_zip("hits", "spans"), lambda x: F.struct(
        x["hits"]["first"].alias("first"), x["hits"]["last"].alias("last"),
        x["spans"]["start"].alias("start"), x["spans"]["end"].alias("end")))

    def add(acc, r):
        last = F.element_at(acc, -1)
        meets = (F.size(acc) > 0) & (r["first"] <= F.get(acc, F.size(acc) - 1)["last"] + 1)
        return F.when(meets, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r)))
    none = F.array().cast("array<struct<first:int,last:int,start:int,end:int>>")
    return every.withColumn("runs", run).groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.aggregate(F.array_sort(F.flatten(F.collect_list("runs"))), none, add).alias("runs")).select(
        "row", "n_words", "item_ids",
        F.transform("runs", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))).alias("hits"),
        F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digest columns of :func:`contamination` per document."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + (r["last"] - r["first"] + 1))
    return contamination(docs, benchmark, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5,
          max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` without benchmark text: found spans are cut out of the text; a document of which more
    than ``max_share`` of the words were hit goes.  All columns are kept as they were.

    With one part the cut runs beside the scan in one map over documents.  With more, the runs of all
    parts are found in the uncut text and united by a key of the row, then cut and judged once.
    """
    flag, key, runs = (unchanged_schema(docs, c) for c in ("hit_share", "clean_row", "clean_runs"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{flag}` double"
    at = docs.columns.index("text")
    parts = item_parts(benchmark, max_bytes)
    if len(parts) == 1:
        out = docs.mapInArrow(_cutter(at, flag, sent(parts[0]), window), schema)
    else:
        rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "decontaminate-docs")
        found = _united(rows.select(F.col(key).alias("row"), F.col("text").cast("string").alias("text")), parts, window) \
            .where(F.size("hits") > 0).select(F.col("row").alias(key), F.col("hits").alias(runs))
        out = rows.join(found, key, "left").select(*docs.columns, runs).mapInArrow(_cutter(at, flag), schema)
    return out.where(F.col(flag) <= max_share).select(*docs.columns)


def _cutter(at: int, flag: str, part=None, window: int = WINDOW):
    """Map: texts without their runs, and the share of words cut.  The runs are those of ``part``, or without one
    those in the last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, symbols = built(part, window) if part else (None, {})
        for batch in batches:
            texts, share = batch.column(at).to_pylist(), []
            given = None if part else batch.column(batch.num_columns - 1).to_pylist()
            for i, text in enumerate(texts):
                raw = (text or "").encode()
                if part:
                    ws = fold_words(raw)
                    _, runs = scan(auto, symbols, ws)
                else:
                    runs = [(r["first"], r["last"]) for r in given[i] or ()]
                    ws = fold_words(raw) if runs else []
                share.append(sum(b - a + 1 for a, b in runs) / len(ws) if runs else 0.0)
                if runs:
                    off, kept, last = word_offsets(raw), [], 0
                    for a, b in runs:
                        kept.append(raw[last:off[a][0]])
                        last = off[b][1]
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
            n = batch.num_columns - (0 if part else 1)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:n])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(share, pa.float64())],
                                             names=[*batch.schema.names[:n], flag])
    return run
