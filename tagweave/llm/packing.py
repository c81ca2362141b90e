"""Packing: optimal length buckets and token-budget batches.

1. Every document is cut into sequences of at most ``max_len`` tokens (all of its tokens are kept).
2. The global histogram of sequence lengths has at most ``max_len`` rows, so it comes to the driver,
   where dynamic programming chooses the ``n_buckets`` boundaries of least total padding.
3. Inside a bucket with boundary b, a batch takes ``budget // b`` sequences (at least one), padded to b.

Batch numbers come from global positions without ordering a bucket in one task: rows are spread over
hashed groups of about ``group_rows``, each group is numbered by itself, and the groups' offsets are prefix
sums over the small table of group counts.  Every batch but a bucket's last is full.  The packing
follows the rows and the parameters alone, not the cluster's settings.

Defined results: null or empty text (no tokens) makes no sequence; a document of exactly max_len
tokens is one sequence; equal lengths share a bucket; boundaries among equally good choices are the
smallest; repeated rows make sequences of their own (numbered in doc_id order, ties by a content hash);
no documents: no rows; null doc_id is kept as null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

MAX_LEN = 2048
BUCKETS = 12
BUDGET = 65_536
GROUP_ROWS = 8192


def boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """At most ``n_buckets`` of ``lengths`` (sorted, distinct), the last included, so that the padding
    sum(count * (boundary above - length)) is least; ties go to smaller boundaries."""
    if not len(lengths):
        return []
    n, weight = np.cumsum(counts, dtype=np.int64), np.cumsum(counts * lengths, dtype=np.int64)
    m = len(lengths)
    # best[j]: least padding of lengths[:j + 1] with its last boundary at lengths[j]
    best = n * lengths - weight
    back = []
    for _ in range(1, min(n_buckets, m)):
        new, frm = best.copy(), np.full(m, -1)
        for j in range(1, m):
            cost = best[:j] + (n[j] - n[:j]) * lengths[j] - (weight[j] - weight[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], frm[j] = cost[i], i
        best = new
        back.append(frm)
    out, j = [int(lengths[-1])], m - 1
    for frm in reversed(back):
        if frm[j] >= 0:
            j = int(frm[j])
            out.append(int(lengths[j]))
    return sorted(set(out))


def sequences(lengths: DataFrame, max_len: int) -> DataFrame:
    """(doc_id, tie, n_tokens) to one row per sequence: piece, start, length."""
    pieces = F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / max_len).cast("int"))
    return lengths.where("n_tokens > 0").select("doc_id", "tie", "n_tokens", F.explode(pieces).alias("piece")).select(
        "doc_id", "tie", "piece", (F.col("piece") * F.lit(max_len).cast("long")).alias("start"),
        F.least(F.lit(max_len).cast("long"), F.col("n_tokens") - F.col("piece") * max_len).cast("int").alias("length"))


def pack(lengths: DataFrame, max_len: int = MAX_LEN, n_buckets: int = BUCKETS, budget: int = BUDGET,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """``lengths``: (doc_id, tie, n_tokens).  One row per sequence with its bucket and batch."""
    spark = lengths.sparkSession
    lengths = staged(lengths, "packing-lengths")  # counted twice: the texts are read once
    rows = sequences(lengths, max_len)
    histogram = rows.groupBy("length").count().collect()  # at most max_len rows
    hist = sorted((r[0], r[1]) for r in histogram)
    size, count = (np.array([h[k] for h in hist], dtype=np.int64) for k in (0, 1))
    bounds = boundaries(size, count, n_buckets)
    schema = ("doc_id long, piece int, start long, length int, bucket int, batch long, slot int")
    if not bounds:
        return spark.createDataFrame([], schema)

    bucket = F.coalesce(*[F.when(F.col("length") <= b, F.lit(b)) for b in bounds])
    in_bucket = np.diff(np.concatenate(([0], np.cumsum(count)[np.searchsorted(size, bounds)])))
    spread = {b: -(-int(c) // group_rows) for b, c in zip(bounds, in_bucket)}
    n_groups = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(s)) for b, s in spread.items()])
    rows = rows.withColumn("bucket", bucket).withColumn(
        "grp", F.pmod(F.xxhash64("doc_id", "tie", "piece"), n_groups).cast("int"))

    # one row per (bucket, group): a row for every `group_rows` sequences
    sizes = rows.groupBy("bucket", "grp").count()
    offsets = sizes.withColumn("offset", F.sum("count").over(
        Window.partitionBy("bucket").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))) \
        .select("bucket", "grp", F.coalesce("offset", F.lit(0)).alias("offset"))
    place = Window.partitionBy("bucket", "grp").orderBy("doc_id", "tie", "piece")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("long")
    # rows are dealt by (bucket, grp) already: this join moves the offsets alone
    return rows.withColumn("at", F.row_number().over(place)).join(offsets, ["bucket", "grp"]) \
        .withColumn("pos", F.col("offset") + F.col("at") - 1) \
        .select("doc_id", "piece", "start", "length", "bucket",
                F.floor(F.col("pos") / per_batch).cast("long").alias("batch"),
                F.pmod(F.col("pos"), per_batch).cast("int").alias("slot"))


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_tokens): the number of blank-separated words of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"),
                       F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))


def tokenizer_lengths(docs: DataFrame, path: str) -> DataFrame:
    """The same with a public tokenizer file (``tokenizers`` JSON) that every worker can open."""
    import pyarrow as pa

    def run(batches):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for b in batches:
            n = [len(tok.encode(t, add_special_tokens=False)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             names=["doc_id", "tie", "n_tokens"])
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")) \
        .mapInArrow(run, "doc_id long, tie long, n_tokens long")


def report(docs: DataFrame) -> DataFrame:
    return pack(word_lengths(docs))
