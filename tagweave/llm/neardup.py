"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are five consecutive lower-cased words (a shorter text is one shingle).  A shingle weighs
tf * idf, idf being the mean over its words of 1 + ln((1 + N) / (1 + df)); document frequencies are
counted over all documents in 2^18 hash buckets of words, a table of fixed size.

1. Equal texts are collapsed to their smallest doc_id.
2. Each text gets 64 weighted samples (ICWS: for a shingle of weight w, t = floor(ln w / r + beta),
   ln a = ln c - r (t - beta) - r; the shingle with the least a is sampled), so two samples agree with
   the probability of the weighted Jaccard similarity.  16 bands of 4: a pair of similarity 0.8 meets
   in some band with probability 0.9998, of 0.9 practically always.
3. In a band bucket every member is compared with a leader, drawn by hash in one of eight orders, so
   a member of a large group meets several leaders, and pairs grow with the members, not their square.
4. Candidates are verified by exact weighted Jaccard similarity on the texts; links form classes.
5. Members outside the class of their bucket's hub (the member most similar to the leaders it met) are
   compared with the hub.
6. What is open after that, two members of a bucket in different classes and not yet compared, is
   compared too, unless a bound rules the link out: the triangle inequality of the weighted Jaccard
   distance over the leader, and a bound on the common weight from the shingles that no other open text
   holds and from bitmaps of hashed shingles (what one text has and the other lacks).  The bounds never
   rule out a link, so none that shares a bucket between two classes is lost, and they are tested inside
   the join, so differently edited copies of one text don't become pairs.

Scale: text is read three times and shuffled once (to fetch the candidates' texts); hot buckets are met
in aggregates with map-side combine and in plain equi-joins that adaptive execution splits.

Defined results: null text and text without words are similar to nothing but an equal text (null: to
nothing); null doc_id gets a null class and stays; class_id is the smallest doc_id of a class; repeated
rows of one doc_id share its class; other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from .common import byte_texts, grams, mix, staged, text_chunks, text_frame, words
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
ORDERS = 8
DF_BITS = 18
_HASH_BITS = 44


# ---------------------------------------------------------------- idf

def _df_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the number of documents that hold a word of each bucket."""
    df = np.zeros(1 << DF_BITS, np.int64)
    for batch in batches:
        texts = byte_texts(batch.column(0))
        for lo, hi in text_chunks(texts):
            w = words(texts[lo:hi])
            key = np.unique((w.doc.astype(np.uint64) << np.uint64(DF_BITS)) | (w.hash >> np.uint64(64 - DF_BITS)))
            df += np.bincount((key & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
    at = np.flatnonzero(df)
    for lo in range(0, len(at), 1 << 15):
        part = at[lo:lo + (1 << 15)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(df[part])], names=["bucket", "df"])


def bucket_idf(docs: DataFrame) -> np.ndarray:
    """ln-scaled idf per bucket (2^18 floats, whatever the size of the corpus)."""
    n = docs.count()
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_df_rows, "bucket int, df long") \
        .groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(1 << DF_BITS)
    df[rows.column("bucket").to_numpy()] = rows.column("df").to_numpy()
    return (1 + np.log((1 + n) / (1 + df))).astype(np.float32)


# ---------------------------------------------------------------- weighted shingles

def shingles(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of a chunk, distinct, sorted by document and shingle."""
    w = words(texts)
    value = idf[(w.hash >> np.uint64(64 - DF_BITS)).astype(np.int64)].astype(np.float64)
    sums = np.concatenate(([0.0], np.cumsum(value)))
    hashes, at = grams(w, SHINGLE)
    docs, weight = [w.doc[at]], [(sums[at + SHINGLE] - sums[at]) / SHINGLE]
    parts = [hashes]
    for n in range(1, SHINGLE):
        first = w.first[w.count == n]
        h = np.full(len(first), n, np.uint64)
        for j in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[first + j])
        parts.append(h)
        docs.append(w.doc[first])
        weight.append((sums[first + n] - sums[first]) / n)
    doc, weight = np.concatenate(docs), np.concatenate(weight)
    key = (doc.astype(np.uint64) << np.uint64(_HASH_BITS)) | (np.concatenate(parts) >> np.uint64(64 - _HASH_BITS))
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(key)))
    # the idf sums come from prefix sums: rounded, so that equal shingles weigh the same everywhere
    weight = np.round(weight[new], 4).astype(np.float32) * tf.astype(np.float32)
    key = key[new]
    return (key >> np.uint64(_HASH_BITS)).astype(np.int64), key & np.uint64((1 << _HASH_BITS) - 1), weight


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles, by 16 random bits, of Gamma(2, 1), its logarithm, and the uniform distribution."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    grid = np.geomspace(1e-4, 60, 200_000)
    gamma = np.interp(u, 1 - (1 + grid) * np.exp(-grid), grid)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32), u.astype(np.float32)


_ICWS: dict[str, tuple] = {}


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, n: int = BANDS * ROWS) -> np.ndarray:
    """ICWS: n samples of each document, as 32-bit words (the sampled ln a names shingle and level);
    documents without shingles get zeros."""
    if "t" not in _ICWS:
        _ICWS["t"] = _tables()
    gamma, ln_gamma, uniform = _ICWS["t"]
    out = np.zeros((n_docs, n), np.uint32)
    if not len(doc):
        return out
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    base = mix(shingle + np.uint64(0x5851F42D4C957F2D))
    ln_w = np.log(weight)
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for j in range(n):
        bits = (base * seeds[j]).view(np.uint16).reshape(-1, 4)
        r, beta, ln_c = gamma[bits[:, 1]], uniform[bits[:, 2]], ln_gamma[bits[:, 3]]
        t = np.floor(ln_w / r + beta)
        out[doc[first], j] = np.minimum.reduceat(ln_c - r * (t - beta) - r, first).view(np.uint32)
    return out


def _band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sample), BANDS), np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sample[:, k::ROWS][:, :BANDS].astype(np.uint64))
    return key.view(np.int64)


def _signer(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, null = byte_texts(batch.column(1)), batch.column(1).is_null().to_pylist()
            digest = np.frombuffer(b"".join(hashlib.md5(t).digest() for t in texts), np.int64).reshape(-1, 2)
            bands: list = []
            for lo, hi in text_chunks(texts):
                doc, sh, weight = shingles(texts[lo:hi], idf.value)
                keys = _band_keys(samples(doc, sh, weight, hi - lo))
                some = np.bincount(doc, minlength=hi - lo) > 0
                bands += [k if s else [] for k, s in zip(keys, some)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest[:, 0], mask=np.array(null)), pa.array(digest[:, 1], mask=np.array(null)),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "bands"])
    return run


# ---------------------------------------------------------------- verification

def similarities(a: list[bytes], b: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of a[i] and b[i]; 0 where neither has a word."""
    out = np.zeros(len(a))
    for lo, hi in text_chunks([x + y for x, y in zip(a, b)]):
        da, sa, wa = shingles(a[lo:hi], idf)
        db, sb, wb = shingles(b[lo:hi], idf)
        ka = (da.astype(np.uint64) << np.uint64(_HASH_BITS)) | sa
        kb = (db.astype(np.uint64) << np.uint64(_HASH_BITS)) | sb
        n = hi - lo
        both = np.zeros(n)
        if len(ka) and len(kb):
            at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
            hit = ka[at] == kb
            both = np.bincount(db[hit], np.minimum(wa[at[hit]], wb[hit]).astype(np.float64), n)
        total = np.bincount(da, wa, n) + np.bincount(db, wb, n) - both
        out[lo:hi] = both / np.maximum(total, 1e-12)
    return out


def _verifier(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = similarities(byte_texts(batch.column(2)), byte_texts(batch.column(3)), idf.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["a", "b", "sim"])
    return run


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, sim) of (a, b); ``texts``: (id, text) of every node in them."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b") \
        .mapInArrow(_verifier(idf), "a long, b long, sim double")


# ---------------------------------------------------------------- classes

def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(bucket_idf(docs))
    base = text_frame(docs)
    signed = staged(base.mapInArrow(_signer(idf), "doc_id long, k1 long, k2 long, bands array<long>"), "neardup-signed")
    same = signed.where("doc_id is not null and k1 is not null")
    # written tables: a join with them deals out both sides anew, so adaptive execution can split a hot key
    first = staged(same.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "neardup-copies")
    members = staged(same.join(first, ["k1", "k2"]), "neardup-members")
    nodes = members.where("doc_id = node").select("node", F.posexplode("bands").alias("band", "key")).distinct()

    order = F.xxhash64("node", F.col("band") % ORDERS)
    leaders = staged(nodes.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", order).alias("leader")).where("n > 1"),
                     "neardup-leaders")
    met = staged(nodes.join(leaders, "key").select("key", "n", "node", "leader"), "neardup-buckets")
    wanted = met.select(F.col("node").alias("wanted_id")).distinct()
    texts = staged(lookup(base, wanted, F.col("doc_id"), "wanted_id", "left_semi").dropDuplicates(["doc_id"]).select(
        F.col("doc_id").alias("id"), "text"), "neardup-texts")

    sims = staged(_verified(_pairs(met, "leader"), texts, idf), "neardup-sims")
    link = F.col("sim") >= threshold
    label = components(sims.where(link))

    hubs = staged(_hub_pairs(met, sims, label), "neardup-hubs")
    more = staged(_verified(hubs, texts, idf), "neardup-sims")
    sims = sims.unionByName(more)
    if not more.where(link).isEmpty():
        label = components(sims.where(link))

    open_pairs = staged(_undecided(met, sims, label, threshold, texts, idf), "neardup-open")
    if not open_pairs.isEmpty():
        rest = staged(_verified(open_pairs, texts, idf).where(link), "neardup-sims")
        if not rest.isEmpty():
            label = components(sims.where(link).unionByName(rest))

    label = label.select(F.col("id").alias("node"), "class_id")
    found = members.select("doc_id", "node").distinct().join(label, "node", "left").select(
        "doc_id", F.coalesce("class_id", "node").alias("class_id")).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return base.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _pairs(rows: DataFrame, other: str) -> DataFrame:
    """Distinct (a, b), a < b, of ``node`` and ``other``."""
    return rows.where(F.col("node") != F.col(other)).select(
        F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def _classed(rows: DataFrame, label: DataFrame, node: str, out: str) -> DataFrame:
    own = label.select(F.col("id").alias(node), F.col("class_id").alias(out))
    return rows.join(own, node, "left").withColumn(out, F.coalesce(out, node))


def _hub_pairs(met: DataFrame, sims: DataFrame, label: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket of three or more with the bucket's hub, where their classes differ."""
    both = sims.select(F.col("a").alias("node"), "sim").unionByName(sims.select(F.col("b").alias("node"), "sim"))
    central = staged(both.groupBy("node").agg(F.avg("sim").alias("mean")), "neardup-central")
    rows = met.where("n > 2").select("key", "node").join(central, "node")
    hub = staged(rows.groupBy("key").agg(F.max_by("node", "mean").alias("hub")), "neardup-hub")
    found = _classed(_classed(met.where("n > 2").join(hub, "key"), label, "node", "class_id"), label, "hub", "hub_class")
    return _pairs(found.where("class_id != hub_class"), "hub").join(sims.select("a", "b"), ["a", "b"], "left_anti")


BITS = 1024


def _share_rows(idf):
    """Map (id, text): every shingle with its share of the text's weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), byte_texts(batch.column(1))
            for lo, hi in text_chunks(texts):
                doc, sh, weight = shingles(texts[lo:hi], idf.value)
                total = np.bincount(doc, weight, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sh.view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array((weight / total[doc]).astype(np.float32))],
                    names=["shingle", "node", "share"])
    return run


def _bitmap_rows(idf):
    """Map (id, text): total weight, least weight of a shingle, and the bitmap of the shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = byte_texts(batch.column(1)), []
            for lo, hi in text_chunks(texts):
                doc, sh, weight = shingles(texts[lo:hi], idf.value)
                on = np.zeros((hi - lo, BITS), bool)
                on[doc, (mix(sh) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
                bits = np.packbits(on, axis=1).view(np.int64)
                least = np.full(hi - lo, np.inf)
                np.minimum.at(least, doc, weight)
                total = np.bincount(doc, weight, hi - lo)
                rows += zip(total.tolist(), least.tolist(), bits.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.float64(), pa.float64(), pa.list_(pa.int64()))))], names=["node", "weight", "least", "bits"])
    return run


def _common_bound(x: str, y: str):
    """At most so much weight of x stands in y as well: without x's shingles that stand nowhere else
    (``alone`` in weight, ``lone`` in number) and at least ``least`` for each further bit that y lacks."""
    lacks = F.lit(0)
    for k in range(BITS // 64):
        lacks = lacks + F.bit_count(F.get(f"{x}_bits", F.lit(k)).bitwiseAND(F.bitwise_not(F.get(f"{y}_bits", F.lit(k)))))
    more = F.greatest(lacks - F.col(f"{x}_lone"), F.lit(0))
    return F.col(f"{x}_weight") - F.col(f"{x}_alone") - more * F.col(f"{x}_least")


def _undecided(met: DataFrame, sims: DataFrame, label: DataFrame, threshold: float, texts: DataFrame, idf) -> DataFrame:
    """Pairs of one bucket, in different classes, neither the leader and not compared yet, that no bound
    rules out.  A similarity of t needs a common weight of t / (1 + t) times both weights."""
    low, high = F.least("node", "leader"), F.greatest("node", "leader")
    known = met.where("n > 2 and node != leader").select("key", "node", "leader", low.alias("a"), high.alias("b")) \
        .join(sims, ["a", "b"]).select("key", "node", "leader", "sim")
    rows = _classed(_classed(known, label, "node", "class_id"), label, "leader", "lead_class").select(
        "key", "node", "sim", "class_id", (F.col("class_id") != F.col("lead_class")).alias("apart"))
    rows = staged(rows, "neardup-rows")
    # a bucket with one class left, or one member besides the leader, has nothing open
    some = staged(rows.groupBy("key").agg(F.count("*").alias("m"), F.count_if("apart").alias("k")).where("m > 1 and k > 0")
                  .select("key"), "neardup-keys")
    rows = staged(rows.join(some, "key"), "neardup-rows")
    here = texts.join(rows.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    alone = here.mapInArrow(_share_rows(idf), "shingle long, node long, share float").groupBy("shingle").agg(
        F.count("*").alias("c"), F.max("node").alias("node"), F.max("share").alias("share")).where("c = 1") \
        .groupBy("node").agg(F.sum("share").alias("share"), F.count("*").alias("lone"))
    own = here.mapInArrow(_bitmap_rows(idf), "node long, weight double, least double, bits array<long>") \
        .join(alone, "node", "left").withColumn("alone", F.col("weight") * F.coalesce("share", F.lit(0.0))) \
        .withColumn("lone", F.coalesce("lone", F.lit(0))).where(F.col("weight") - F.col("alone") >= F.col("weight") * (threshold - 1e-4))
    own = staged(own.drop("share"), "neardup-bounds")
    rows = rows.join(own, "node")
    names = ["node", "sim", "class_id", "apart", "weight", "alone", "lone", "least", "bits"]
    f, m = (rows.select("key", *[F.col(c).alias(f"{x}_{c}") for c in names]) for x in "fm")
    near = F.abs(F.col("f_sim") - F.col("m_sim")) <= 1 - threshold + 1e-6
    need = (threshold / (1 + threshold) - 1e-4) * (F.col("f_weight") + F.col("m_weight"))
    pairs = f.where("f_apart").join(m, (f["key"] == m["key"]) & (F.col("f_class_id") != F.col("m_class_id")) & near
                                    & (~F.col("m_apart") | (F.col("f_node") < F.col("m_node")))
                                    & (F.least("f_weight", "m_weight") >= need)
                                    & (_common_bound("f", "m") >= need) & (_common_bound("m", "f") >= need)) \
        .select(F.least("f_node", "m_node").alias("a"), F.greatest("f_node", "m_node").alias("b")).distinct()
    return pairs.join(sims.select("a", "b"), ["a", "b"], "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, and whether the document is the one of its class that stays."""
    return classes(docs).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class (the smallest doc_id), columns as they were; of repeated
    rows with equal doc_id and text one stays."""
    found = staged(classes(docs), "neardup-classes")
    key = "_gone_id"
    while key in docs.columns:
        key = "_" + key
    # the documents that go are looked up under a measured bound, so that whole texts are not shuffled for them
    gone = found.where("doc_id != class_id").select(F.col("doc_id").alias(key)).distinct()
    twice = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key)
    here = F.col("doc_id").cast("long") == F.col(key)
    rest = lookup(docs, gone, F.col("doc_id").cast("long"), key).where(F.col(key).isNull()).drop(key)
    if twice.isEmpty():
        return rest.select(*docs.columns)
    again = rest.join(twice, here, "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(twice, here, "left_anti").unionByName(again).select(*docs.columns)
