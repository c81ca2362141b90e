"""Classifier scores: heads, top-k, label lookup, threshold, tag strings and
the multi-model ensemble.

A score vector stays an array on its (image, model) row for as long as
possible: top-k, label lookup and the duplicate-label rule are row-local
array expressions, so a batch tagging job has no shuffle.  Only the
ensemble, which averages over models, regroups by (image, tag).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_root
from ..sources.paths import open_path
from .lookup import lookup

# Labels kept per image and model, and the default threshold.
TOP_K = 250
DEFAULT_THRESHOLD = 0.2
MICRO = 1_000_000  # integer score unit: score = micro / MICRO


# ------------------------------------------------------------------ vectors

def model_slices(embeddings: DataFrame, models: list[tuple[str, int, int]], image: str = "vec_id",
                 vec: str = "embedding") -> DataFrame:
    """One row per (image, model): the model's raw output vector, taken as
    the slice ``[lo, hi]`` of the stored vector.  The model list is a job
    parameter (a few entries), expanded row-locally without a join."""
    cfg = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("model_ord"), F.lit(lo).alias("lo"),
                             F.lit(hi).alias("hi")) for i, (m, lo, hi) in enumerate(models)])
    e = embeddings.select(F.col(image).alias("image"), F.col(vec).alias("v"), F.explode(cfg).alias("m"))
    return e.select("image", "m.model", "m.model_ord",
                    F.slice("v", F.col("m.lo") + 1, F.col("m.hi") - F.col("m.lo") + 1).alias("raw"))


def micro_scores(raw: Column) -> Column:
    """Exact integer form of scores in [-1, 1]: ``floor((v + 1) * 500000)``,
    read as a score in [0, 1] with unit 1e-6."""
    return F.transform(raw, lambda v: F.floor((v.cast("double") + 1) * 500000).cast("bigint"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def auto_sigmoid(vec: Column) -> Column:
    """M3: a vector already inside [0, 1] is a probability; anything else
    is a logit and goes through the sigmoid."""
    v = F.transform(vec, lambda x: x.cast("double"))
    is_prob = (F.array_min(v) >= 0) & (F.array_max(v) <= 1)
    return F.when(is_prob, v).otherwise(F.transform(v, sigmoid))


# -------------------------------------------------------------------- heads

HEAD_BLOCK = 1024  # labels of a stored block
BLOCK_BYTES = 64 << 20  # a block's dense size; wide heads get fewer labels a block
KEPT_BYTES = 256 << 20  # blocks a task keeps in memory (``Head.keep``); it reads the others again for every batch


class Head:
    """A head's weights as a stored table of dense blocks, one folder ``block=<n>`` each, which tasks read.
    A block without a folder is all zeros."""

    def __init__(self, folder: str, n_labels: int, n_dims: int, block: int, keep: int = KEPT_BYTES):
        self.folder, self.n_labels, self.n_dims, self.block, self.keep = folder, n_labels, n_dims, block, keep

    def read(self, n: int) -> np.ndarray:
        """Block ``n``: its labels x dims."""
        rows = min(self.block, self.n_labels - n * self.block)
        files, at = open_path(f"{self.folder}/block={n}")
        if files.get_file_info(at).type == pafs.FileType.NotFound:
            return np.zeros((rows, self.n_dims))
        got = pq.read_table(at, columns=["mat"], filesystem=files, partitioning=None)
        return np.frombuffer(got.column("mat")[0].as_py(), np.float64).reshape(rows, self.n_dims)

    def blocks(self, kept: dict[int, np.ndarray]):
        """The blocks in order; ``kept`` holds the first ``keep`` bytes of them between calls."""
        for n in range(-(-self.n_labels // self.block)):
            mat = kept[n] if n in kept else self.read(n)
            if n not in kept and sum(m.nbytes for m in kept.values()) + mat.nbytes <= self.keep:
                kept[n] = mat
            yield mat


def store_head(weights: DataFrame, block: int = HEAD_BLOCK, label: str = "l", dim: str = "e", w: str = "w",
               folder: str | None = None) -> Head:
    """Write a head's weights ``(label, dim, w)`` as dense blocks of ``block`` labels (fewer where a block would
    pass ``BLOCK_BYTES``) under ``folder`` (default: the shared stage folder).  Spark groups the weights by block
    and every block is built in its own task; the driver sees the head's two sizes only.  Labels without weight
    rows are zero rows; rows with a null are ignored; repeated places count with their largest weight."""
    rows = weights.select(F.col(label).cast("long").alias("l"), F.col(dim).cast("long").alias("e"),
                          F.col(w).cast("double").alias("w")).dropna()
    top = rows.agg(F.max("l"), F.max("e")).first()
    n_l, n_e = (0, 0) if top[0] is None else (int(top[0]) + 1, int(top[1]) + 1)
    block = max(1, min(block, BLOCK_BYTES // (8 * max(n_e, 1))))
    path = f"{(folder or stage_root(weights.sparkSession)).rstrip('/')}/head-{uuid.uuid4().hex}"

    def dense(key, pdf):
        pdf = pdf.sort_values("w")
        mat = np.zeros((min(block, n_l - key[0] * block), n_e))
        mat[pdf["l"].to_numpy() - key[0] * block, pdf["e"].to_numpy()] = pdf["w"].to_numpy()
        return pd.DataFrame({"block": [key[0]], "mat": [mat.tobytes()]})

    rows.groupBy(F.floor(F.col("l") / block).alias("block")).applyInPandas(dense, "block long, mat binary") \
        .write.partitionBy("block").parquet(path)
    return Head(path, n_l, n_e, block)


def dense_scores(embeddings: DataFrame, weights: DataFrame | Head, head: str = "linear", bias: np.ndarray | None = None,
                 image: str = "vec_id", vec: str = "embedding", block: int = HEAD_BLOCK,
                 top: int | None = None) -> DataFrame:
    """M1/M2: ``sigmoid(W x + b)`` (linear) or ``sigmoid(first half) *
    sigmoid(second half)`` (gated) for every image, as ``(image, scores
    array<double>)``; the image id keeps its type.

    A Python step is used on purpose: the head is a dense matrix product,
    done per Arrow batch with BLAS (``mapInPandas``).  The weights are a
    stored table of dense blocks (``store_head``; a stored ``Head`` may be
    passed to use it again) that tasks read themselves, so the embeddings are
    read once, nothing is shuffled but the weights, and a task holds
    ``KEPT_BYTES`` of weights at most.  With ``top`` only the best ``top``
    ``(idx, score)`` of an image (ties by index) leave Python instead of the
    whole vector."""
    stored = weights if isinstance(weights, Head) else store_head(weights, block)
    b = np.zeros(stored.n_labels) if bias is None else np.asarray(bias, dtype=np.float64)
    gated = head == "gated"
    src = embeddings.select(F.col(image).alias("image"), F.col(vec).alias("v"))
    best = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([T.StructField("image", src.schema["image"].dataType),
                           T.StructField("scores", T.ArrayType(T.DoubleType()) if top is None else best)])

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            z = np.hstack([np.zeros((len(pdf), 0)), *(x @ m.T for m in stored.blocks(kept))]) + b
            s = 1.0 / (1.0 + np.exp(-z))
            if gated:
                c = z.shape[1] // 2
                s = s[:, :c] * s[:, c:]
            if top is None:
                out = list(s)
            else:
                order = np.argsort(-s, axis=1, kind="stable")[:, :top]
                out = [[{"idx": int(i), "score": float(r[i])} for i in o] for r, o in zip(s, order)]
            yield pd.DataFrame({"image": pdf["image"].to_numpy(), "scores": out})

    return src.mapInPandas(run, schema)


# -------------------------------------------------------------------- top-k

def topk(scores: Column, k: int = TOP_K) -> Column:
    """The ``min(k, size)`` best ``struct(neg, idx, score)`` of a score
    vector, best first, ties broken by label index (row-local sort)."""
    keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("idx"), s.alias("score")))
    return F.slice(F.sort_array(keyed), 1, F.least(F.lit(k), F.size(scores)))


def topk_rows(scores: DataFrame, k: int = TOP_K, keys=("image", "model"), score: str = "score",
              idx: str = "idx") -> DataFrame:
    """W1 for scores stored as rows ``(image, model, idx, score)``: the best
    ``k`` per (image, model), ties by label index, with ``rank`` from 0.
    Planned as a partial top-k before the shuffle (WindowGroupLimit), so a
    partition sends at most k rows per key; a key holds one image's labels
    (bounded by the vocabulary)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(idx))
    r = scores.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)  # a filter on row_number itself
    return r.withColumn("rank", F.col("_rn") - 1).drop("_rn")


def label_arrays(vocab: DataFrame, model: str = "model", idx: str = "idx", tag: str = "tag") -> DataFrame:
    """Vocabulary ``(model, idx, tag)`` -> ``(model, labels array<string>)``
    with ``labels[idx]`` the tag (indices are dense per model)."""
    g = vocab.groupBy(F.col(model).alias("model")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(tag).alias("t")))).alias("s"))
    return g.select("model", F.transform("s", lambda x: x["t"]).alias("labels"))


def attach_labels(rows: DataFrame, vocab: DataFrame, top: str = "top") -> DataFrame:
    """J9 + P7 row-locally: give every top-k entry its label text; entries
    whose index is outside the vocabulary are dropped.  The label arrays,
    one row per model, are written and measured first and then broadcast
    (a bounded lookup), so the images are never shuffled by model."""
    labels = label_arrays(vocab).withColumnRenamed("model", "_model")
    j = lookup(rows, labels, F.col("model"), "_model", "inner").drop("_model")
    lab = F.transform(top, lambda x: F.struct(x["idx"].alias("idx"), x["score"].alias("score"),
                                              F.get(F.col("labels"), x["idx"]).alias("tag")))
    return j.withColumn(top, F.filter(lab, lambda x: x["tag"].isNotNull())).drop("labels")


_RANKED = "struct<tag:string,score:bigint,rank:int>"


def dedup_labels(top) -> Column:
    """One entry per label text; its place is the first (best) one, its
    score the lowest one (the reference fills a dict in descending order).
    Returns ``array<struct<tag, score, rank>>`` in rank order, O(k log k).

    No lambda refers to another computed array (Catalyst would inline it and
    re-evaluate it per element): the lowest score per tag comes from the
    tag-sorted array zipped with itself shifted by one, the first rank per
    tag from ``array_distinct``, and the two tag-sorted lists are zipped.
    """
    top = F.col(top) if isinstance(top, str) else top
    ranked = F.transform(top, lambda x, i: F.struct(x["tag"].alias("tag"), x["score"].cast("bigint").alias("score"),
                                                    i.alias("rank")))
    by_tag = F.sort_array(ranked)  # tag, then lowest score first
    prev = F.concat(F.array(F.lit(None).cast(_RANKED)), by_tag)
    marked = F.zip_with(by_tag, prev, lambda c, p: F.struct(
        c["tag"].alias("tag"), c["score"].alias("score"),
        (c["tag"].isNotNull() & (p.isNull() | (p["tag"] != c["tag"]))).alias("first")))
    lowest = F.filter(marked, lambda x: x["first"])
    first_rank = F.sort_array(F.transform(F.array_distinct(F.transform(ranked, lambda x: x["tag"])),
                                          lambda t, r: F.struct(t.alias("tag"), r.alias("rank"))))
    joined = F.zip_with(first_rank, lowest, lambda o, lo: F.struct(o["rank"].alias("rank"), o["tag"].alias("tag"),
                                                                  lo["score"].alias("score")))
    return F.transform(F.sort_array(joined), lambda x: F.struct(x["tag"].alias("tag"), x["score"].alias("score"),
                                                               x["rank"].alias("rank")))


def tag_string(dedup: Column, threshold_micro: int) -> Column:
    """G4 + P5: labels whose (lowest) score is strictly above the
    threshold, in rank order, joined by ``", "``."""
    return F.array_join(F.transform(F.filter(dedup, lambda x: x["score"] > threshold_micro), lambda x: x["tag"]), ", ")


def batch_tag(slices: DataFrame, vocab: DataFrame, threshold: float = DEFAULT_THRESHOLD, k: int = TOP_K,
              scores: str = "scores") -> DataFrame:
    """M4: vector -> top-k -> labels -> threshold -> tag string, one row per
    (image, model)."""
    thr = int(round(threshold * MICRO))
    r = slices.select("image", "model", topk(F.col(scores), k).alias("top"))
    r = attach_labels(r, vocab)
    return r.select("image", "model", tag_string(dedup_labels("top"), thr).alias("text"))


def ensemble(slices: DataFrame, vocab: DataFrame, k: int = TOP_K, scores: str = "scores") -> DataFrame:
    """A3 before the threshold: per (image, tag) the sum and count of the
    (deduplicated) top-k scores over the models that returned the tag, and
    the G3 order key ``(first model, rank there)``.  One shuffle by
    (image, tag); sum/count/min combine map-side."""
    r = slices.select("image", "model", "model_ord", topk(F.col(scores), k).alias("top"))
    r = attach_labels(r, vocab)
    e = r.select("image", "model_ord", F.explode(dedup_labels("top")).alias("x"))
    return e.groupBy("image", F.col("x.tag").alias("tag")).agg(
        F.sum("x.score").cast("bigint").alias("sum_micro"),
        F.count(F.lit(1)).cast("bigint").alias("n_models"),
        F.min(F.struct("model_ord", F.col("x.rank").alias("rank"))).alias("first"))


def above(sum_col: Column, n_col: Column, threshold: float) -> Column:
    """P5 on a mean kept as (sum, count): ``sum / n > thr`` exactly."""
    return sum_col > F.lit(int(round(threshold * MICRO))) * n_col


def ensemble_tag_string(ens: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Visible tags per image, first model's rank order, then tags new
    in later models."""
    vis = ens.where(above(F.col("sum_micro"), F.col("n_models"), threshold))
    g = vis.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("first", "tag"))).alias("s"))
    return g.select("image", F.array_join(F.transform("s", lambda x: x["tag"]), ", ").alias("text"))


def label_index(vocab: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested (model, tag) -> label index; a repeated label text
    maps to its last index (dict built in list order); unknown tags give no
    row."""
    last = vocab.groupBy("model", "tag").agg(F.max("idx").alias("idx"))
    return requests.join(last, ["model", "tag"], "inner")


def pad_labels(vocab: DataFrame, num_classes: DataFrame, n_placeholders: int = 3) -> DataFrame:
    """Append ``placeholder0..`` labels to a model's vocabulary only
    when that makes its size equal the model's class count."""
    sizes = vocab.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    need = sizes.join(num_classes, "model").where(F.col("n") + n_placeholders == F.col("num_classes"))
    extra = need.select("model", "n", F.posexplode(F.array_repeat(F.lit(0), n_placeholders)).alias("i", "_z"))
    extra = extra.select("model", (F.col("n") + F.col("i")).cast("int").alias("idx"),
                         F.concat(F.lit("placeholder"), F.col("i").cast("string")).alias("tag"))
    return vocab.select("model", F.col("idx").cast("int").alias("idx"), "tag").unionByName(extra)
