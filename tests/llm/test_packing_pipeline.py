"""Operator 7 and the pipeline."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as cp
from tagweave.llm import packing as pk


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(hist, k):
    lengths, counts = (np.array(x) for x in zip(*sorted(hist.items())))
    got = pk.boundaries(lengths, counts, k)
    assert got[-1] == lengths[-1] and len(got) <= k and set(got) <= set(lengths.tolist())
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(k) for c in itertools.combinations(lengths[:-1].tolist(), n))
    assert padding(lengths, counts, got) == best


def check_batches(rows, lengths, max_len, budget):
    seqs = {}
    for r in rows:
        assert r["length"] <= r["bucket"] and r["start"] == r["piece"] * max_len
        seqs.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    for (bucket, batch), slots in seqs.items():
        per = max(1, budget // bucket)
        last = max(b for k, b in seqs if k == bucket)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= per  # a budget's worth, each place once
        assert batch == last or len(slots) == per  # only a bucket's last batch may be short
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {d: n for d, n in lengths.items() if n}  # every token of every document, once


def test_pack(spark):
    rng = np.random.default_rng(0)
    n = {i: int(x) for i, x in enumerate(rng.integers(0, 400, 800))}
    n.update({1000 + i: 33 for i in range(500)})  # a hot length
    n.update({2000: 50_000, 2001: 128, 2002: 129})
    df = spark.createDataFrame([(d, 0, x) for d, x in n.items()], "doc_id long, tie long, n_tokens long")
    rows = pk.pack(df, max_len=128, n_buckets=5, budget=1000).collect()
    check_batches(rows, n, 128, 1000)
    assert len({r["bucket"] for r in rows}) == 5
    pieces = sorted((r["piece"], r["length"]) for r in rows if r["doc_id"] == 2000)
    assert pieces == [(i, 128) for i in range(390)] + [(390, 80)]
    assert [(r["piece"], r["length"]) for r in rows if r["doc_id"] == 2001] == [(0, 128)]
    again = pk.pack(df.repartition(7), max_len=128, n_buckets=5, budget=1000).collect()
    assert sorted(rows) == sorted(again)  # numbering does not depend on the partitioning
    # the buckets are those of the best histogram split
    hist = {}
    for r in rows:
        hist[r["length"]] = hist.get(r["length"], 0) + 1
    size, count = (np.array(x) for x in zip(*sorted(hist.items())))
    assert sorted({r["bucket"] for r in rows}) == pk.boundaries(size, count, 5)


def test_packing_follows_the_rows_not_the_shuffle_setting(spark, docs):
    key = "spark.sql.shuffle.partitions"
    old, seen = spark.conf.get(key), []
    try:
        for n in ("3", "17"):
            spark.conf.set(key, n)
            rows = pk.pack(pk.word_lengths(docs.repartition(int(n))), group_rows=50).collect()
            seen.append(sorted(map(tuple, rows), key=str))
    finally:
        spark.conf.set(key, old)
    assert seen[0] == seen[1] and len(seen[0]) >= docs.where("text is not null and text != ''").count() * 0.9
    slots = {(r[4], r[5], r[6]) for r in seen[0]}
    assert len(slots) == len(seen[0])  # no slot of a batch is given twice


def test_small_budget_and_ties(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 5, 10), (None, 1, 3), (2, 0, 0)], "doc_id long, tie long, n_tokens long")
    rows = pk.pack(df, max_len=8, n_buckets=3, budget=1).collect()
    assert len(rows) == 5 and all(r["slot"] == 0 for r in rows)
    assert pk.pack(df.limit(0)).count() == 0 and pk.pack(df.limit(0)).columns == pk.pack(df).columns


def test_word_lengths(spark, edge, empty, docs):
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in pk.word_lengths(edge).collect())
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode().split())) for r in edge.collect())
    assert got == want
    assert pk.report(empty).count() == 0
    lengths = {r["doc_id"]: len(r["text"].encode().split()) for r in docs.select("doc_id", "text").collect()}
    check_batches(pk.report(docs).collect(), lengths, pk.MAX_LEN, pk.BUDGET)


def test_tokenizer_lengths(spark):
    import importlib.util

    import pytest
    spec = importlib.util.spec_from_file_location("public_tokenizers", "/opt/tokenizers/__init__.py")
    if spec is None:
        pytest.skip("no public tokenizer files here")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in pk.tokenizer_lengths(df, path).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_pipeline_stages(spark, docs):
    """Each stage on its predecessor's rows: the columns of documents, only rows that were there, and the
    result of run() is that of the stages one by one."""
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    now, text = docs, {}
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stage(spark, now, sf)
        assert now.columns == docs.columns and now.schema == docs.schema or [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        rows = now.collect()
        text = {r["doc_id"]: r["text"] for r in rows}
        assert len(text) == len(rows) and set(text) <= set(before)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name in ("quality", "near_duplicates"):
            assert all(before[d] == t for d, t in text.items())
        if name == "line_dedup":
            assert set(text) == set(before)
        now = spark.createDataFrame(rows, docs.schema)
    lengths = {d: len(t.encode().split()) for d, t in text.items()}
    out = cp.STAGES[-1][1](spark, now, sf).collect()
    check_batches(out, lengths, pk.MAX_LEN, pk.BUDGET)
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, out))


def test_pipeline_on_edge_rows(spark, edge, empty):
    sf = "/root/testdata/sf0.001"
    for frame in (edge, empty):
        now = frame
        for _, stage in cp.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == frame.columns
        cp.STAGES[-1][1](spark, now, sf).collect()


def test_no_labels_no_benchmark(spark, docs, tmpdir_run):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmpdir_run}/{t}.parquet")
    assert cp.quality_stage(spark, docs, tmpdir_run).count() == docs.count()
    assert cp.decontamination_stage(spark, docs, tmpdir_run).exceptAll(docs).count() == 0
