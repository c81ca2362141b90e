"""Operators 1 and 2 against brute force and on edge rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import decontaminate as dc
from tagweave.llm import topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_topk(rows, every, k):
    """rows: (vec_id, list of floats); the contract, pair by pair."""
    use = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
           if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, qv in use:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in use if i != q and len(v) == len(qv))[:k]
            out |= {(q, r + 1, i, -n) for r, (n, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("shard_rows,block_rows,group_roots", [(8192, 2048, 1024), (40, 3, 4), (7, 50, 1000)])
def test_topk_equals_brute_force(spark, shard_rows, block_rows, group_roots):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of the rows is one vector: ties go to small ids
    rows += [(2000, None), (None, [0.1] * 6), (2001, [0.1, None] * 3), (2002, [float("nan")] * 6), (2003, []), (2020, [0.5, 0.5])]
    rows += [(2 ** 63 - 1, [0.9] * 6), (-(2 ** 63), [-0.9] * 6), (2021, [0.25, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    v = topk.quantised(df)
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), 20, shard_rows, block_rows, group_roots)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_topk(rows, 20, 20))


def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 40, (30, 16))
    return np.floor(np.concatenate([c + rng.normal(0, 2, (200, 16)) for c in centres])).astype(np.int64)


def test_topk_tree_nodes_hold_their_rows():
    x = clustered()
    tree = topk.BallTree.unpack(topk.BallTree(np.arange(len(x)), x).pack())
    for (a, b, left, right), c, r in zip(tree.nodes, tree.centre, tree.radius):
        assert (((tree.rows[a:b] - c) ** 2).sum(axis=1) <= r * r + 1e-6).all()
        if left >= 0:
            assert tree.nodes[left][0] == a and tree.nodes[left][1] == tree.nodes[right][0] and tree.nodes[right][1] == b
        else:
            assert b - a <= topk.LEAF_ROWS
    assert (x[tree.ids] == tree.rows).all()


def test_topk_cuts_subtrees_and_stays_exact():
    x = clustered()
    tree = topk.BallTree(np.arange(len(x)), x)
    q, leaves = x[::97], int((tree.nodes[:, 2] < 0).sum())
    ids, none = np.full(len(q), -1), np.full(len(q), topk.NO_FLOOR)
    scored = np.zeros(len(q), int)
    at, vec, score = topk.search(tree, ids, q, none, 5, scored)
    for i in range(len(q)):
        s = x @ q[i]
        want = np.lexsort((np.arange(len(x)), -s))[:5]
        assert list(vec[at == i]) == list(want) and list(score[at == i]) == list(s[want])
    assert 1 <= scored.min() and scored.mean() < leaves / 5
    # a shared k-th score cuts more and leaves only what reaches it
    floor = np.array([score[at == i].min() for i in range(len(q))])
    again = np.zeros(len(q), int)
    at2, vec2, _ = topk.search(tree, ids, q, floor + 1, 5, again)
    assert len(at2) < len(at) and (again <= scored).all()
    # a floor above every bound cuts the root: no leaf is scored
    top = topk.bounds(q.astype(float), tree.centre[:1], tree.radius[:1])[:, 0]
    over = np.zeros(len(q), int)
    assert topk.search(tree, ids, q, np.ceil(top).astype(np.int64) + 1, 5, over).shape[1] == 0 and over.sum() == 0


def test_topk_sends_queries_only_to_shards_that_can_reach_their_floor():
    x = clustered()
    planes = topk.fit_planes(x[::7].astype(float), 5)
    region = topk.region_of(x.astype(float), *planes)
    assert region.min() >= 0 and region.max() < 32 and len(set(region.tolist())) > 16
    trees = {g: topk.BallTree(np.flatnonzero(region == g), x[region == g]) for g in set(region.tolist())}
    roots = [{"region": g, "piece": 0, "centre": t.centre[0].tobytes(), "radius": float(t.radius[0])} for g, t in trees.items()]
    q = x[::97]
    ids = np.arange(len(q))
    best = np.sort(x @ q.T, axis=0)[-5]

    def routed(pilot):
        row = {"dim": 16, "block": 0, "ids": ids.tobytes(), "rows": q.tobytes(), "roots": roots,
               "floors": [{"query_id": int(i), "kth": int(b)} for i, b in zip(ids, best)]}
        batch = topk.pa.RecordBatch.from_pylist([row])
        return [(r["region"], i) for b in topk._router(pilot)(iter([batch])) for r in b.to_pylist()
                for i in np.frombuffer(r["ids"], np.int64).tolist()]

    first, rest = routed(True), routed(False)
    assert sorted(i for _, i in first) == ids.tolist() and not set(first) & set(rest)
    assert len(rest) < len(q) * len(roots) / 2
    score = x @ q.T
    needed = {(region[v], i) for i in ids.tolist() for v in np.flatnonzero(score[:, i] >= best[i])}
    assert needed <= set(first) | set(rest)


def test_topk_exact_beyond_doubles(spark):
    big = 2 ** 40
    v = spark.createDataFrame([(0, [big, 1]), (1, [big, 3]), (2, [big, 2])], "vec_id long, v array<long>")
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()]
    top = min(2 ** 63 - 1, big * big + 3)
    assert [g[:2] for g in got] == [(0, 1), (0, 2)] and got[0][3] == top


def test_topk_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.report(none).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.report(one).collect() == []


def brute_contamination(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = folded(t)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                wins.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = folded(t), set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                own = wins.get(tuple(w[p:p + n]))
                if own:
                    hit |= set(range(p, p + n))
                    ids |= own
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "a b c d e f g h i j k"), (2, "Short Item"), (3, "short item"), (4, ""), (5, None), (None, "x y"), (10, "é ß 9 A")]
DOCS = [(1, "A b, C d-e f g h i j k l"), (2, "b c d e f g h i j"), (3, "a short item; short ITEM short"), (4, None), (5, ""),
        (6, "pre é ß 9 a post é ß 9"), (7, "x y"), (8, "a b c d e f g h i j a b c d e f g h i j k"), (None, "short item")]


@pytest.mark.parametrize("max_bytes", [1 << 20, 8])
def test_contamination_equals_brute_force(spark, max_bytes, monkeypatch):
    """Also with a benchmark beyond the broadcast bound, scanned part by part."""
    monkeypatch.setattr(dc.contamination, "__defaults__", (10, max_bytes))
    d = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("hits", F.lit(1))
    b = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_words", F.lit("x"))
    got = sorted((tuple(r) for r in dc.report(d, b).collect()), key=str)
    assert got == brute_contamination(DOCS, ITEMS)


def test_spans_map_to_the_original_text(spark):
    text = "Start. A, b; C d e (F) g h I: j -- k and é then."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    r = dc.contamination(d, b).first()
    assert [text.encode()[s["start"]:s["end"]].decode() for s in r["spans"]] == ["A, b; C d e (F) g h I: j -- k"]
    kept = dc.clean(d, b, max_share=1.0).first()["text"]
    assert kept == "Start.  and é then."


def test_clean_keeps_columns_and_edges(spark, edge, empty, benchmark):
    out = dc.clean(edge, benchmark)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert dc.clean(empty, benchmark).count() == 0 and dc.report(empty, benchmark).count() == 0
    none = benchmark.limit(0)
    assert dc.report(edge, none).where("contaminated").count() == 0
    assert dc.report(edge, benchmark).count() == edge.count()
    mostly = spark.createDataFrame([(1, ITEMS[0][1]), (2, "clean text")], "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [r["doc_id"] for r in dc.clean(mostly, b).collect()] == [2]


def test_clean_does_not_depend_on_the_parts(spark, edge, benchmark):
    """Overlapping and adjoining hits of several parts, words that meet only after a cut, and the share over all parts."""
    items = [(1, "a b c d"), (2, "c d e f"), (3, "g h"), (4, "p q r s"), (5, "x y"), (6, "k l")]
    docs = [(1, "0 1 2 3 4 5 6 a b c d e f 7 8"),  # a part-2 hit overlaps one of part 1
            (2, "0 1 2 3 4 5 6 7 a b c d, g h 8"),  # adjoining runs are one
            (3, "0 1 2 3 p q x y r s 4 5 6 7"),  # p q r s stand together only after a cut
            (4, "a b c d 0 p q r s 1"),  # 40% by each of two items: goes
            (5, None), (6, "clean"), (6, "clean"), (None, "0 1 2 3 k l")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, dc.clean(d, b, 4).collect()))
    assert len(dc.item_parts(b, 1)) > 5 and len(want) == 7
    for max_bytes in (1, 12):
        assert sorted(map(str, dc.clean(d, b, 4, max_bytes=max_bytes).collect())) == want
        one, many = (sorted(map(str, dc.contamination(d, b, 4, m).collect())) for m in (1 << 20, max_bytes))
        assert one == many
    out = dc.clean(edge, benchmark, max_bytes=1 << 13)
    assert out.columns == edge.columns and sorted(map(str, out.collect())) == sorted(map(str, dc.clean(edge, benchmark).collect()))
