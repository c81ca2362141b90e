"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds
t_1 < t_2 < ... give P(grade >= k) = sigmoid(score - t_k).  The expected grade is the sum of the tail
probabilities over grades, and selection is a bound on one tail probability.

Features are means over a document's words of hashed one-hot terms: the word itself, its outer shape
(letter case, first byte, last two bytes, length), and whether it repeats the word one or two before.
Means keep short and long texts on one scale.

Fit: at most ``max_rows`` labelled documents (a documented bound, chosen by hash of the id, so it does
not depend on the order of the input) meet in one task as hashed means.  Scoring: a map over all
documents with the weights (2^18 floats, 1 MB) in the function; no shuffle.

Defined results: null or empty text has no features and gets the score 0 (tail probabilities from the
thresholds alone); labels with null id or rating are ignored, repeated labels count once per document
(the lowest rating); with no labels or only one grade every document gets that grade with probability
1 and none is rejected; repeated rows are each scored; other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EXACT, NON_SPACE, byte_texts, mix, text_chunks, text_frame, unchanged_schema, words

BITS = 18
MAX_ROWS = 6000

# byte classes of the shape features
_CLASS = np.array([1 if 0x61 <= b <= 0x7A else 2 if 0x41 <= b <= 0x5A else 3 if 0x30 <= b <= 0x39 else 4 if b >= 0x80
                   else 8 + b for b in range(256)], dtype=np.uint64)


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every term of a chunk, and the number of words of each document."""
    w = words(texts, NON_SPACE, EXACT)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.count
    cls = _CLASS[w.buf]
    length = w.end - w.start
    last, before = cls[w.end - 1], cls[np.maximum(w.end - 2, w.start)]
    shape = ((cls[w.start] * np.uint64(256) + last) * np.uint64(256) + before) * np.uint64(16) \
        + np.minimum(length, 15).astype(np.uint64)
    same = np.zeros((2, len(w.hash)), bool)
    for k in (1, 2):
        same[k - 1, k:] = (w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k])
    repeat = np.uint64(1) + same[0] + np.uint64(2) * same[1]
    terms = [w.hash, mix(shape + np.uint64(1 << 40)), mix(repeat + np.uint64(1 << 41))]
    return np.tile(w.doc, 3), (np.concatenate(terms) >> np.uint64(64 - bits)).astype(np.int64), w.count


def _counts(key: str, bits: int):
    """Map: the hashed mean features of each document, as two binary columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            ids, means = [], []
            for lo, hi in text_chunks(texts):
                doc, bucket, n = features(texts[lo:hi], bits)
                keys, counts = np.unique((doc << bits) | bucket, return_counts=True)
                cut = np.searchsorted(keys, np.arange(hi - lo + 1) << bits)
                for d in range(hi - lo):
                    own = slice(cut[d], cut[d + 1])
                    ids.append((keys[own] & ((1 << bits) - 1)).astype(np.int32).tobytes())
                    means.append((counts[own] / max(1, n[d])).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(ids, pa.binary()), pa.array(means, pa.binary())],
                names=["rating", "ids", "means"])
    return run


class CumulativeLink:
    """Shared weights and ordered thresholds; ``grades`` are the sorted ratings seen."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[float]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for every grade above the lowest, one column each."""
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds[None, :])))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        low = self.grades[0] if self.grades else 0.0
        return low + tails @ np.diff(np.asarray(self.grades, dtype=np.float64)) if len(self.grades) > 1 \
            else np.full(len(tails), low, dtype=np.float64)

    def tail_from(self, tails: np.ndarray, rating: float) -> np.ndarray:
        """P(grade >= rating); 1 where no grade is below it."""
        below = sum(g < rating for g in self.grades)
        if below == 0 or len(self.grades) < 2:
            return np.ones(len(tails))
        return tails[:, below - 1] if below <= tails.shape[1] else np.zeros(len(tails))


def fit_rows(rows: list[tuple[float, np.ndarray, np.ndarray]], bits: int = BITS, steps: int = 150,
             rate: float = 0.3, decay: float = 1e-4) -> CumulativeLink:
    """Maximum likelihood by Adam over the whole (bounded) sample.

    Thresholds are a first one and positive steps above it, so they stay ordered.
    """
    grades = sorted({r[0] for r in rows})
    size = 1 << bits
    if len(grades) < 2:
        return CumulativeLink(np.zeros(size, np.float32), np.zeros(0), grades)
    y = np.array([grades.index(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    used, col = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    val = np.concatenate([r[2] for r in rows]).astype(np.float64)
    k = len(grades) - 1
    share = np.array([(y > j).mean() for j in range(k)]).clip(0.01, 0.99)
    first = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, cut = p[:len(used)], p[len(used):]
        theta = cut[0] + np.concatenate(([0.0], np.cumsum(np.exp(cut[1:]))))
        s = np.bincount(row, w[col] * val, len(rows))
        # P(grade > j): padded with 1 below the lowest and 0 above the highest
        up = 1 / (1 + np.exp(-(s[:, None] - theta[None, :])))
        padded = np.column_stack([np.ones(len(rows)), up, np.zeros(len(rows))])
        slope = padded * (1 - padded)
        i = np.arange(len(rows))
        prob = np.maximum(padded[i, y] - padded[i, y + 1], 1e-9)
        ds = -(slope[i, y] - slope[i, y + 1]) / prob / len(rows)
        dt = np.zeros(k + 2)
        np.add.at(dt, y, slope[i, y] / prob / len(rows))
        np.add.at(dt, y + 1, -slope[i, y + 1] / prob / len(rows))
        dt = dt[1:-1]
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(col, ds[row] * val, len(used)) + decay * w / len(used),
                            tail[:1], tail[1:] * np.exp(cut[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = p[:len(used)]
    cut = p[len(used):]
    return CumulativeLink(weights, cut[0] + np.concatenate(([0.0], np.cumsum(np.exp(cut[1:])))), grades)


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, rating) of at most ``max_rows`` labelled documents, chosen by hash of the id.

    The chosen ids are bounded by the parameter, hence the broadcast."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("rating").isNotNull()) \
        .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.col("rating").cast("double")).alias("rating")) \
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    return text_frame(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "rating")


def _fitted(bits: int):
    """The whole (bounded) sample in one task: fit, and return the model as one row."""
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(((y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for y, i, v in zip(
            *(t.column(c).to_pylist() for c in ("rating", "ids", "means")))), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
        m = fit_rows(rows, bits)
        return pa.table({"weights": [m.weights.tobytes()], "thresholds": [m.thresholds.tolist()], "grades": [m.grades]},
                        schema=pa.schema([("weights", pa.binary()), ("thresholds", pa.list_(pa.float64())),
                                          ("grades", pa.list_(pa.float64()))]))
    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> CumulativeLink:
    """``labels``: (doc_id, rating).  The bounded sample's hashed means meet in one task, which fits; only
    the model (1 MB) comes to the driver."""
    rows = sampled(docs, labels, max_rows).mapInArrow(
        _counts("rating", bits), "rating double, ids binary, means binary")
    got = rows.groupBy(F.lit(1).alias("all")).applyInArrow(
        _fitted(bits), "weights binary, thresholds array<double>, grades array<double>").first()
    if got is None:
        return fit_rows([], bits)
    return CumulativeLink(np.frombuffer(got[0], np.float32), np.array(got[1], dtype=np.float64), list(got[2]))


def scores(docs: DataFrame, model: CumulativeLink, select_from: float, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, score, expected_grade and tail (P(grade >= select_from))."""
    bits = int(np.log2(len(model.weights)))
    names = [unchanged_schema(docs, c) for c in ("n_words", "score", "expected_grade", "tail")]
    keep = keep or ("doc_id",)
    base = docs.select(*keep, F.col("text").cast("string").alias(unchanged_schema(docs, "scored_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(batch.num_columns - 1))
            n, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for lo, hi in text_chunks(texts):
                doc, bucket, count = features(texts[lo:hi], bits)
                n[lo:hi] = count
                score[lo:hi] = np.bincount(doc, model.weights[bucket], hi - lo) / np.maximum(count, 1)
            tails = model.tails(score)
            cols = [n, score, model.expected(tails), model.tail_from(tails, select_from)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, cols)],
                                             names=[*batch.schema.names[:-1], *names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{schema}, `{names[0]}` long, " + ", ".join(f"`{c}` double" for c in names[1:]))


def select(docs: DataFrame, model: CumulativeLink, select_from: float, least: float = 0.5) -> DataFrame:
    """The documents whose P(grade >= select_from) is ``least`` or more, columns as they were."""
    tail = unchanged_schema(docs, "tail")
    return scores(docs, model, select_from, *docs.columns).where(F.col(tail) >= least).select(*docs.columns)


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings from the two given labels: 0 poor, 1 fair (good text, but toxic), 2 good."""
    q, t = F.col("quality").cast("double"), F.coalesce(F.col("toxic").cast("double"), F.lit(0.0))
    return labels.select("doc_id", F.when(q == 0, 0.0).when(q.isNotNull(), 2.0 - t).alias("rating"))


def report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Fit on the bounded sample, score every document; kept: P(grade >= 1) is 0.5 or more."""
    model = fit(docs, ratings(labels), max_rows)
    return scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, 1.0, "doc_id") \
        .withColumn("kept", F.col("tail") >= 0.5)
