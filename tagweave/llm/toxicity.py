"""Toxicity: a factorisation machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 where a term occurs.  The
pairwise part, in its linear-time form, learns interactions (an insult together with a group mention)
that additive weights miss.

Terms are lower-cased words and their leading 5 to 8 bytes, hashed into a table of 2^18 buckets.  Every
bucket that the bounded training sample holds takes part in the fit with a weight, and factors do not
depend on its own (marginal) effect, so an interaction of terms that say nothing alone can be learnt.

Fit: at most ``max_rows`` labelled documents (a documented bound, by hash of the id) meet in one task as
lists of buckets.  The weights come first, by sparse mini-batches and proximal steps: a step is measured in
units of the term's own noise (the spread its gradient would have by chance), and what stays under a few of
those units is drawn to 0, so rare terms can't learn the sample by heart, and a long clean text does not add
up noise.  Factors that start at random drown in the hundreds of terms of a whole text; so they start from the
pairs of terms in which the weights err beyond chance, among the ``PAIR_TERMS`` terms of the largest variance
in the sample (the share of texts with the term times that without; rarer terms meet too seldom to tell), and
are then learnt together with the weights.
Scoring: a map over all documents with the model in the function (at most 2^18 rows); no shuffle.

Defined results: null or empty text has no terms and scores sigmoid(b); labels with null id or label
are ignored, repeated ones count once (the largest); without labels of both kinds every score is the
share of label 1 (practically 0 with none); repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_texts, mix, powers, text_chunks, text_frame, words

MAX_ROWS = 20_000
BITS = 18
HASH_BITS = 40
FACTORS = 8
PAIR_TERMS = 4096
PREFIXES = (5, 6, 7, 8)
HELD_OUT = 2


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) of a chunk; terms are 40-bit hashes."""
    w = words(texts)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = powers(len(w.buf) + 1)
    sums = np.zeros(len(w.buf) + 1, np.uint64)
    np.cumsum(LOWER[w.buf] * power[:len(w.buf)], out=sums[1:])
    docs, hashes = [w.doc], [w.hash]
    length = w.end - w.start
    for n in PREFIXES:
        long = np.flatnonzero(length > n)
        s = w.start[long]
        docs.append(w.doc[long])
        hashes.append(mix((sums[s + n] - sums[s]) * inverse[s] + np.uint64(n << 48)))
    key = (np.concatenate(docs).astype(np.uint64) << np.uint64(40)) | (np.concatenate(hashes) >> np.uint64(24))
    key = np.unique(key)
    return (key >> np.uint64(40)).astype(np.int64), (key & np.uint64((1 << 40) - 1)).astype(np.int64)


class FactorizationMachine:
    """``terms``: the sorted buckets (of 2^``bits``) that have parameters; all others weigh nothing."""

    def __init__(self, terms: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray, bits: int = BITS):
        self.terms, self.bias, self.linear, self.factors, self.bits = terms, bias, linear, factors, bits
        self.place = np.full(1 << bits, -1, np.int32)
        self.place[terms] = np.arange(len(terms))

    def known(self, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, index of the model's bucket) of the terms that have parameters; the input is sorted."""
        at = self.place[term >> (HASH_BITS - self.bits)]
        hit = np.flatnonzero(at >= 0)
        doc, at = doc[hit], at[hit]
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        return doc[new], at[new]

    def trimmed(self) -> FactorizationMachine:
        """The same scores without the rows that are all 0."""
        kept = np.flatnonzero((self.linear != 0) | self.factors.any(1))
        return FactorizationMachine(self.terms[kept], self.bias, self.linear[kept], self.factors[kept], self.bits)

    def margin(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, self.linear[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in text_chunks(texts):
            out[lo:hi] = self.margin(*self.known(*terms(texts[lo:hi])), hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


class _Batch:
    """Rows of the sample in both orders: by row (``col``, from ``start``) and by column (``row``, from ``first``)."""

    def __init__(self, rows: np.ndarray, present: list[np.ndarray]):
        count = np.array([len(present[i]) for i in rows])
        self.rows, self.has = rows, np.flatnonzero(count)
        self.col = np.concatenate([present[i] for i in rows]).astype(np.int32)
        self.start = (np.cumsum(count) - count)[self.has]
        order = np.argsort(self.col, kind="stable")
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), count)[order]
        self.used, self.first = np.unique(self.col[order], return_index=True)

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """Sums over each row's terms of ``x``, one entry per (row, term)."""
        out = np.zeros((len(self.rows), *x.shape[1:]), np.float32)
        if len(self.has):
            out[self.has] = np.add.reduceat(x, self.start)
        return out

    def by_column(self, x: np.ndarray) -> np.ndarray:
        """Sums over the rows that hold each of ``used``, of ``x`` per row."""
        return np.add.reduceat(x[self.row], self.first)


def _interactions(present: list[np.ndarray], residual: np.ndarray, m: int, pair_terms: int, least_z: float,
                  block: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of columns whose joint residual goes beyond what either column alone tells and beyond chance:
    (columns, i, j, weight), i and j being indexes of ``columns``.  Of the ``pair_terms`` columns of the
    largest variance all pairs are weighed, in matrix products over blocks of rows."""
    n = len(present)
    freq = np.bincount(np.concatenate(present), minlength=m) / n
    cols = np.sort(np.argsort(-freq * (1 - freq), kind="stable")[:pair_terms])
    cols = cols[freq[cols] * (1 - freq[cols]) > 0]
    place = np.full(m, -1, np.int32)
    place[cols] = np.arange(len(cols))
    joint, both = (np.zeros((len(cols), len(cols)), np.float32) for _ in range(2))
    square = np.zeros(len(cols))
    for lo in range(0, n, block):
        x = np.zeros((min(block, n - lo), len(cols)), np.float32)
        for row, p in enumerate(present[lo:lo + block]):
            at = place[p]
            x[row, at[at >= 0]] = 1
        r = residual[lo:lo + block, None].astype(np.float32)
        joint += x.T @ (r * x)
        both += x.T @ x
        square += (r * r * x).sum(0)
    own = np.maximum(both.diagonal(), 1)
    alone, spread = np.abs(joint.diagonal()) / own, square / own
    found = []
    for i in range(len(cols)):  # a row of the upper triangle at a time
        j = slice(i + 1, len(cols))
        var = both[i, j] * np.maximum(spread[i], spread[j]) + 1e-9
        more = np.abs(joint[i, j]) - both[i, j] * np.maximum(alone[i], alone[j])
        at = np.flatnonzero(more > least_z * np.sqrt(var))
        found.append(np.stack([np.full(len(at), i), at + i + 1, np.sign(joint[i, j][at]) * more[at] / (var[at] + 1)]))
    i, j, weight = np.concatenate(found, axis=1) if found else np.zeros((3, 0))
    return cols, i.astype(int), j.astype(int), np.clip(weight, -2, 2)


def _start(cols: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray, factors: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, factor rows) whose products approximate the pairs' weights: the largest eigenvectors of their
    matrix; its diagonal, which a factorisation machine does not use, is raised until no eigenvalue is negative."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    if not len(used):
        return np.zeros(0, np.int64), np.zeros((0, factors))
    pairs = np.zeros((len(used), len(used)))
    pairs[at[:len(i)], at[len(i):]] = pairs[at[len(i):], at[:len(i)]] = weight
    np.fill_diagonal(pairs, np.abs(pairs).sum(1))
    value, vector = np.linalg.eigh(pairs)
    top = np.argsort(-value, kind="stable")[:factors]
    out = np.zeros((len(used), factors))
    out[:, :len(top)] = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
    return cols[used], out


def fit_rows(vocabulary: np.ndarray, present: list[np.ndarray], label: np.ndarray, factors: int = FACTORS,
             epochs: int = 20, rate: float = 0.02, linear_noise: float = 2.5, pair_terms: int = PAIR_TERMS,
             least_z: float = 7.0, batches: int = 8, seed: int = 7, bits: int = BITS) -> FactorizationMachine:
    """Logistic loss over the (bounded) sample by proximal mini-batch steps; ``present`` holds indexes of
    ``vocabulary``.  First the weights, drawn to 0 by ``linear_noise`` standard deviations of their gradient
    under chance (an L1 penalty); then weights and factors together, the factors from the pairs in which the
    first fit errs by more than ``least_z`` deviations."""
    share = float(label.mean()) if len(label) else 0.0
    n, m, k = len(label), len(vocabulary), factors
    if not 0 < share < 1 or not m:
        bias = 40.0 * np.sign(share - 0.5) if share in (0.0, 1.0) else np.log(share / (1 - share))
        return FactorizationMachine(np.zeros(0, np.int64), float(bias), np.zeros(0), np.zeros((0, k)), bits)
    rng = np.random.default_rng(seed)
    size = -(-n // batches)
    order = rng.permutation(n)
    parts = [_Batch(order[lo:lo + size], present) for lo in range(0, n, size)]
    parts = [p for p in parts if len(p.col)]
    freq = np.bincount(np.concatenate([p.col for p in parts]), minlength=m) / n
    noise = np.sqrt(np.maximum(freq, 1 / n) * share * (1 - share) / size).astype(np.float32)
    chance = (size / n) ** 0.5  # the spread of a gradient over the whole sample, in units of a batch's
    bias, w, v = np.log(share / (1 - share)), np.zeros(m, np.float32), np.zeros((m, k), np.float32)
    paired = np.zeros(0, np.int64)

    def margins(p: _Batch) -> tuple[np.ndarray, np.ndarray]:
        own = v[p.col]
        s = p.by_row(own)
        return bias + p.by_row(w[p.col]) + 0.5 * ((s ** 2).sum(1) - p.by_row((own ** 2).sum(1))), s

    for stage in ("weights", "factors"):
        if stage == "factors":
            residual = np.zeros(n)
            residual[:] = label - share
            for p in parts:
                residual[p.rows] = label[p.rows] - 1 / (1 + np.exp(-np.clip(margins(p)[0], -40, 40)))
            paired, start = _start(*_interactions(present, residual, m, pair_terms, least_z), k)
            if not len(paired):
                break
            v[paired] = start
        mom_b = var_b = 0.0
        mom_w, mom_v, var_v, t = np.zeros_like(w), np.zeros((len(paired), k)), np.zeros((len(paired), k)), 0
        for _ in range(epochs):
            for at in rng.permutation(len(parts)):
                p = parts[at]
                z, s = margins(p) if len(paired) else (bias + p.by_row(w[p.col]), None)
                d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[p.rows]) / len(p.rows)).astype(np.float32)
                g = p.by_column(d)
                t += 1
                left = 1 - 0.9 ** t
                mom_b, var_b = 0.9 * mom_b + 0.1 * d.sum(), 0.999 * var_b + 0.001 * d.sum() ** 2
                bias -= rate * (mom_b / left) / (np.sqrt(var_b / (1 - 0.999 ** t)) + 1e-8)
                mom_w *= 0.9
                mom_w[p.used] += 0.1 * g
                step = w - rate * mom_w / left / noise
                w = np.sign(step) * np.maximum(0, np.abs(step) - rate * linear_noise * chance)
                if len(paired):
                    full = np.zeros((m, k), np.float32)
                    full[p.used] = p.by_column(d[:, None] * s) - v[p.used] * g[:, None]
                    g = full[paired]
                    mom_v, var_v = 0.9 * mom_v + 0.1 * g, 0.99 * var_v + 0.01 * g * g
                    v[paired] -= rate * mom_v / left / (np.sqrt(var_v / (1 - 0.99 ** t)) + 1e-8)
    return FactorizationMachine(vocabulary, float(bias), w.astype(np.float64), v.astype(np.float64), bits)


def held_out(doc_id):
    """crc32(doc_id as text) mod 4 is 2: rows whose labels are never learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled rows to learn from (a bounded set of ids, hence
    the broadcast)."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("double").alias("label")) \
        .where(F.col("label_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("label_id"))) \
        .groupBy("label_id").agg(F.max("label").alias("label")) \
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    return text_frame(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "label")


def _presence(bits: int):
    """Map (text, label): label and the buckets present, as binary."""
    every = FactorizationMachine(np.arange(1 << bits), 0.0, np.zeros(0), np.zeros((0, 0)), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = byte_texts(batch.column(0)), []
            for lo, hi in text_chunks(texts):
                doc, at = every.known(*terms(texts[lo:hi]))
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                out += [at[cut[i]:cut[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["label", "at"])
    return run


def _fitted(bits: int):
    """The whole (bounded) sample in one task: fit, and return the model as one row."""
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("label").to_pylist(), t.column("at").to_pylist()))
        present = [np.frombuffer(b, np.int32) for _, b in rows]
        used = np.flatnonzero(np.bincount(np.concatenate(present), minlength=1 << bits))
        place = np.zeros(1 << bits, np.int32)
        place[used] = np.arange(len(used))
        m = fit_rows(used, [place[p] for p in present], np.array([y for y, _ in rows]), bits=bits).trimmed()
        return pa.table({"terms": [m.terms.astype(np.int64).tobytes()], "bias": [m.bias], "linear": [m.linear.tobytes()],
                         "factors": [m.factors.tobytes()]},
                        schema=pa.schema([("terms", pa.binary()), ("bias", pa.float64()), ("linear", pa.binary()),
                                          ("factors", pa.binary())]))
    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> FactorizationMachine:
    """The bounded sample's buckets meet in one task, which fits; only the model comes to the driver."""
    got = sampled(docs, labels, max_rows).mapInArrow(_presence(bits), "label double, at binary") \
        .groupBy(F.lit(1).alias("all")) \
        .applyInArrow(_fitted(bits), "terms binary, bias double, linear binary, factors binary").first()
    if got is None:
        return fit_rows(np.zeros(0, np.int64), [], np.zeros(0), bits=bits)
    return FactorizationMachine(np.frombuffer(got[0], np.int64), got[1], np.frombuffer(got[2], np.float64),
                                np.frombuffer(got[3], np.float64).reshape(-1, FACTORS), bits)


def scores(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(byte_texts(batch.column(1))), pa.float64())],
                                             names=["doc_id", "score"])
    return text_frame(docs).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, cut: float = 0.3) -> DataFrame:
    return scores(docs, fit(docs, labels, max_rows)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))
