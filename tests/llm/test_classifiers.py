"""Operators 6 and 10: fits against brute force, held-out accuracy, edge rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm import quality as qu
from tagweave.llm import toxicity as tx


def _log_likelihood(rows, w, theta):
    total = 0.0
    for y, ids, val in rows:
        s = float((w[ids] * val).sum())
        tails = [1.0, *(1 / (1 + np.exp(-(s - t))) for t in theta), 0.0]
        total += np.log(max(tails[int(y)] - tails[int(y) + 1], 1e-12))
    return total / len(rows)


def test_cumulative_link_learns_ordered_grades():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(1500):
        x = rng.random(3)
        y = float(np.digitize(4 * x[0] - 4 * x[1] + rng.logistic(0, 0.3), [-1.0, 0.5, 1.5]))
        rows.append((y, np.array([1, 5, 9], np.int32), x.astype(np.float32)))
    m = qu.fit_rows(rows, bits=4)
    assert m.grades == [0.0, 1.0, 2.0, 3.0] and (np.diff(m.thresholds) > 0).all()
    assert m.weights[1] > 5 and m.weights[5] < -5 and abs(m.weights[9]) < 2
    # no nearby parameters are much better: the optimum was found
    base = _log_likelihood(rows, m.weights, m.thresholds)
    for _ in range(10):
        w = m.weights + rng.normal(0, 0.3, m.weights.shape)
        assert _log_likelihood(rows, w, m.thresholds) < base + 1e-3
    tails = m.tails(np.array([-5.0, 0.0, 5.0]))
    assert (np.diff(tails, axis=1) <= 0).all()  # P(grade >= k) falls with k
    e = m.expected(tails)
    assert (np.diff(e) > 0).all() and 0 <= e[0] and e[-1] <= 3
    assert np.allclose(m.tail_from(tails, 2.0), tails[:, 1]) and (m.tail_from(tails, 0.0) == 1).all()
    assert (m.tail_from(tails, 9.0) == 0).all()


def test_one_or_no_grade():
    one = qu.fit_rows([(2.0, np.array([1], np.int32), np.array([1.0], np.float32))], bits=4)
    t = one.tails(np.zeros(2))
    assert list(one.expected(t)) == [2.0, 2.0] and list(one.tail_from(t, 1.0)) == [1.0, 1.0]
    none = qu.fit_rows([], bits=4)
    assert list(none.tail_from(none.tails(np.zeros(1)), 1.0)) == [1.0]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("doc_id % 3 <> 0")
    model = qu.fit(docs, qu.ratings(learn))
    test = qu.scores(docs, model, 1.0, "doc_id").join(labels.where("doc_id % 3 = 0"), "doc_id")
    r = test.agg(F.avg(((F.col("tail") >= 0.5).cast("int") == F.col("quality")).cast("double")).alias("acc"),
                 F.avg(F.when(F.col("quality") == 1, (F.col("tail") >= 0.5).cast("double"))).alias("kept")).first()
    assert r["acc"] > 0.9 and r["kept"] > 0.97
    # the bound is a parameter, and the sample does not depend on the order of the input
    small = qu.sampled(docs, qu.ratings(labels), 20)
    assert small.count() == 20
    again = qu.sampled(docs.orderBy(F.rand(1)), qu.ratings(labels.orderBy(F.rand(2))), 20)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, again.collect()))


def test_quality_edges(spark, edge, empty, docs, labels):
    odd = labels.select("doc_id", "quality", "toxic").unionByName(
        spark.createDataFrame([(None, 1, 0), (3, None, 1), (3, 0, None)], "doc_id long, quality int, toxic int"))
    model = qu.fit(docs, qu.ratings(odd))
    out = qu.select(edge, model, 1.0)
    assert out.columns == edge.columns
    assert qu.scores(edge, model, 1.0, *edge.columns).count() == edge.count()
    assert qu.report(edge, labels.limit(0)).where("kept").count() == edge.count()  # no labels: nothing is rejected
    assert qu.report(empty, labels).count() == 0


def test_terms_and_margin_equal_the_plain_formula():
    rng = np.random.default_rng(2)
    m = tx.FactorizationMachine(np.arange(0, 50, 5), 0.3, rng.normal(size=10), rng.normal(size=(10, 4)))
    doc = np.array([0, 0, 0, 2, 2])
    at = np.array([1, 4, 7, 0, 9])
    got = m.margin(doc, at, 3)
    for d in range(3):
        i = at[doc == d]
        want = 0.3 + m.linear[i].sum() + sum(m.factors[a] @ m.factors[b] for k, a in enumerate(i) for b in i[k + 1:])
        assert np.isclose(got[d], want)
    one = tx.terms([b"Idiot idiot", b"", b"abcdefghij"])
    assert list(np.bincount(one[0], minlength=3)) == [1, 0, 5]  # a word once; the long word with four prefixes


def test_fm_learns_an_interaction():
    """Label 1 only where two terms meet: no additive weights can tell that at one threshold this well."""
    rng = np.random.default_rng(4)
    x = rng.random((3000, 6)) < 0.5
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    m = tx.fit_rows(np.arange(6), [np.flatnonzero(r) for r in x], y, epochs=60)
    doc, at = np.nonzero(x)
    assert (((m.margin(doc, at, len(x)) > 0) == (y == 1)).mean()) > 0.95


def test_fit_learns_an_interaction_without_marginal_effect(spark):
    """fit() itself: two terms that say nothing alone, among far more chance terms than a cut by own effect would keep."""
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for i in range(10_000):
        if n < 3000 and zlib.crc32(str(i).encode()) % 4 != 2:
            a, b = n & 1, n >> 1 & 1  # every combination equally often
            n += 1
        else:
            a, b = rng.integers(0, 2, 2)
        noise = [f"n{x}" for x in rng.choice(4000, 10, replace=False)]
        rows.append((i, " ".join(["alpha"] * a + ["omega"] * b + noise), int(a ^ b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2][:3000]
    model = tx.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in learnt], "doc_id long, toxic int"))
    rest = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = (model.score([r[1].encode() for r in rest]) > 0.5) == np.array([r[2] == 1 for r in rest])
    assert right.mean() > 0.95


def test_interaction_is_found_in_whole_texts(spark):
    """Two words planted in the documents of sf0.1, each in half of them: their exclusive or is learnt by factors alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null")
    bit = [F.xxhash64("doc_id", F.lit(i)) % 2 == 0 for i in (1, 2)]
    planted = docs.select("doc_id", F.concat("text", *[F.when(b, F.lit(w)).otherwise("") for b, w in zip(bit, (" zalpha", " zomega"))])
                          .alias("text"), (bit[0] != bit[1]).cast("int").alias("toxic"))
    model = tx.fit(planted, planted, 4000)
    assert model.factors.any(1).sum() >= 2
    test = tx.scores(planted, model).join(planted.where(tx.held_out(F.col("doc_id"))), "doc_id")
    assert test.agg(F.avg(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("double"))).first()[0] > 0.97
    flat = tx.FactorizationMachine(model.terms, model.bias, model.linear, 0 * model.factors, model.bits)
    assert len(set(flat.score([b"the zalpha", b"the zomega", b"zalpha zomega"]) > 0.5)) == 1  # weights alone can't tell


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = tx.sampled(docs, labels, 5000).count()
    out = tx.report(docs, labels, 5000)
    assert out.count() == docs.count() and 0 < seen <= 5000
    for r in out.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    test = out.where("held_out").join(labels, "doc_id")
    r = test.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"),
                 F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["recall"] > 0.75 and r["false"] < 0.01


def test_toxicity_edges(spark, edge, empty, docs, labels):
    odd = labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (2, None)], "doc_id long, toxic int"))
    assert tx.report(edge, odd).count() == edge.count()
    assert tx.report(empty, labels).count() == 0
    none = tx.report(docs, labels.limit(0))
    assert none.where("score > 1e-12 or predicted <> 0").count() == 0
    ids = {r["label_id"] for r in labels.select(F.col("doc_id").alias("label_id")).where(tx.held_out(F.col("doc_id"))).collect()}
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)
