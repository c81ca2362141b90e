"""Bounded lookups, the stored score table, the reply store, the caption folder, file digests and the record reader."""

import csv
import hashlib
import io
import os
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagweave.operators import dictionary as dic
from tagweave.operators import digests as dg
from tagweave.operators import hooks as hk
from tagweave.operators import replies as rp
from tagweave.operators import score_store as ss
from tagweave.operators import scores as sc
from tagweave.operators.lookup import lookup, table_bytes
from tagweave.plans import catalog
from tagweave.plans import curation as cu
from tagweave.sources import caption_folder as cf
from tagweave.sources import files as rd
from tagweave.sources.records import read_records
from tests.conftest import SF_SMALL


def executed(df) -> str:
    """The plan as adaptive execution ran it."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- bounded lookup

def _facts(spark):
    rng = random.Random(2)
    keys = ["hot"] * 400 + [None] * 200 + [f"k{rng.randint(0, 60)}" for _ in range(300)] + ["", "nowhere"]
    return spark.createDataFrame(list(enumerate(keys)), "id long, k string"), \
        spark.createDataFrame([("hot", 1), ("", 2)] + [(f"k{i}", i) for i in range(0, 60, 2)], "name string, v int")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_within_and_beyond_its_bound(spark, how):
    facts, small = _facts(spark)
    want = Counter(map(tuple, facts.join(small, facts.k == small.name, how).collect()))
    for bound, share in ((1 << 20, 1e-4), (0, 0.1), (0, 1e-4), (0, 1.0)):
        got = lookup(facts, small, F.col("k"), "name", how, bound=bound, share=share)
        assert Counter(map(tuple, got.collect())) == want, (bound, share)


def test_lookup_plans(spark):
    facts, small = _facts(spark)
    near = executed(lookup(facts, small, F.col("k"), "name"))
    assert "BroadcastHashJoin" in near and "hashpartitioning" not in near
    # beyond the bound the hot keys (one value and null) are looked up without a shuffle of their facts
    beyond = lookup(facts, small, F.col("k"), "name", bound=0, share=0.1)
    plan = beyond._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Left") + plan.count("Join LeftOuter") >= 3 and "Union" in plan
    assert table_bytes(small.limit(0)) == 0 < table_bytes(small) < 64 * 40


@pytest.mark.parametrize("key", ["sanitize", "known_tags", "canonical_tags", "tag_category", "merge_priority", "batch_tag"])
def test_no_fact_row_moves_before_a_lookup(spark, key):
    """The only exchanges by hash are regroups by name (one), never by tag, canonical tag or model."""
    plan = executed(catalog.QUERIES[key](spark, SF_SMALL))
    final = plan.split("== Initial Plan ==")[0]
    moved = [line for line in final.splitlines() if "Exchange hashpartitioning" in line]
    assert all("(name#" in line for line in moved) and len(moved) <= 1, moved
    if key == "batch_tag":
        assert "BuildRight" in final and "BuildLeft" not in final


def test_lookup_beyond_its_bound_makes_facts_once_and_moves_rare_keys_only(spark, monkeypatch):
    from tagweave.operators import lookup as lk
    rng = random.Random(8)
    keys = [k for i in range(40) for k in [f"k{i}"] * (1600 // (i + 1))] + [None] * 300 + ["unknown"] * 500
    rng.shuffle(keys)
    facts = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    small = spark.createDataFrame([(f"k{i}", i) for i in range(0, 60, 2)], "name string, v int")
    written = {}
    plain = lk.staged
    monkeypatch.setattr(lk, "staged", lambda df, name: written.setdefault(name, []).append(plain(df, name)) or written[name][-1])
    for how in ("left", "inner", "left_semi"):
        want = Counter(map(tuple, facts.join(small, facts.k == small.name, how).collect()))
        for bound in (200, 900, 1500):
            written.clear()
            got = lookup(facts, small, F.col("k"), "name", how, bound=bound, share=1.0, stored=True)
            assert Counter(map(tuple, got.collect())) == want
            assert [len(written[n]) for n in ("lookup-facts", "lookup-keys")] == [1, 1]
            found = written["lookup-keys"][0]
            hot = found.where(F.col("_step") >= lk._cut(found, bound))
            assert 0 < table_bytes(hot) <= bound
    # the widest bound holds the keys of most facts: a fifth at most would be shuffled
    assert hot.agg(F.sum("_n")).first()[0] > 0.8 * len(keys)


@pytest.mark.parametrize("key", ["drop_categories", "drop_year_tags", "known_tags", "canonical_tags"])
def test_captions_are_dealt_by_name_before_their_tags_are_rows(spark, key):
    """One exchange, of whole captions: below the explode, by name."""
    final = executed(catalog.QUERIES[key](spark, SF_SMALL)).split("== Initial Plan ==")[0]
    at = [i for i, line in enumerate(final.splitlines()) if "Exchange hashpartitioning" in line]
    made = [i for i, line in enumerate(final.splitlines()) if "Generate posexplode" in line]
    assert len(at) == 1 and made and at[0] > made[0] and "SortMergeJoin" not in final
    assert "(name#" in final.splitlines()[at[0]]


# ---------------------------------------------------------------- stored scores

def _ensemble(spark):
    rng = random.Random(4)
    rows = [(i, f"tag{t:03d}", rng.randint(0, 3_000_000), n, (rng.randint(0, 2), t)) for i in range(60) for t in range(40)
            for n in [rng.randint(1, 3)]]
    rows += [(99, "edge", 1_000_000, 2, (0, 1)), (99, "above", 1_000_001, 2, (0, 2)), (99, "zero", 0, 1, (0, 3)),
             (99, "one", 3_000_000, 3, (1, 1))]
    rows = [(i, t, min(s, n * 1_000_000), n, f) for i, t, s, n, f in rows]
    return rows, spark.createDataFrame(rows, "image long, tag string, sum_micro long, n_models long, "
                                             "first struct<model_ord:int,rank:int>")


def test_another_threshold_reads_only_files_that_can_pass(spark, tmpdir_run):
    rows, ens = _ensemble(spark)
    path = os.path.join(tmpdir_run, "scores")
    ss.write_scores(ens, path, files_per_band=2)
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)
    for threshold in (0.0, 0.2, 0.5, 0.55, 0.999999, 1.0):
        got = ss.read_scores(spark, path, threshold)
        want = {(i, t) for i, t, s, n, _ in rows if s > threshold * 1_000_000 * n}
        assert {(r.image, r.tag) for r in got.select("image", "tag").collect()} == want
    plan = executed(ss.read_scores(spark, path, 0.75))
    assert "PartitionFilters: [isnotnull(band" in plan and "PushedFilters: [IsNotNull(mean_micro)" in plan
    opened = ss.read_scores(spark, path, 0.75).select(F.input_file_name().alias("f")).distinct().count()
    in_bands = sum(f.endswith(".parquet") for d, _, names in os.walk(path) for f in names
                   if "band=" in d and int(d.rsplit("=", 1)[1]) >= 15)
    assert opened <= in_bands < files // 2
    assert {r.tag for r in ss.read_scores(spark, path, 0.2, ["tag003", "edge"]).collect()} == {"tag003", "edge"}
    all_rows = ss.read_scores(spark, path)
    assert all_rows.count() == len(rows)
    thr = 0.55
    assert sorted(map(tuple, sc.ensemble_tag_string(ss.read_scores(spark, path, thr), thr).collect())) == \
        sorted(map(tuple, sc.ensemble_tag_string(ens, thr).collect()))


def test_an_empty_score_table(spark, tmpdir_run):
    _, ens = _ensemble(spark)
    path = os.path.join(tmpdir_run, "none")
    ss.write_scores(ens.limit(0), path)
    assert ss.read_scores(spark, path, 0.2).count() == 0


# ---------------------------------------------------------------- reply store

def _log(folder, prompts):
    for p in prompts:
        fd, _ = tempfile.mkstemp(prefix=f"{p}-", dir=folder)
        os.close(fd)


def _asked(folder) -> Counter:
    return Counter(f.split("-")[0] for f in os.listdir(folder))


def test_a_killed_stage_resumes_and_asks_nothing_twice(spark, tmpdir_run):
    log, store, flag = (os.path.join(tmpdir_run, x) for x in ("log", "store", "dying"))
    os.makedirs(log)
    df = spark.createDataFrame([(i, f"p{i % 300}") for i in range(600)], "id long, prompt string")

    def call(prompts):
        if os.path.exists(flag) and len(os.listdir(log)) >= 100:
            os._exit(3)  # the worker dies between two batches
        _log(log, prompts)
        return [p.upper() for p in prompts]

    open(flag, "w").close()
    with pytest.raises(Exception):
        rp.resumable_hook(df, call, store, keep=["id"], batch=10, bucket=50).collect()
    done = _asked(log)
    assert 100 <= len(done) < 300 and set(done.values()) == {1}
    os.remove(flag)
    for _ in range(2):  # a resumed run, then one that has nothing to ask
        got = rp.resumable_hook(df, call, store, keep=["id"], batch=10, bucket=50).collect()
        assert {r.id: (r.reply, r.error) for r in got} == {i: (f"P{i % 300}", None) for i in range(600)}
    assert _asked(log) == Counter({f"p{i}": 1 for i in range(300)})


def test_a_retried_task_goes_on_after_its_last_batch(spark, tmpdir_run):
    """The same bucket seen again in the same run: what is stored is not asked."""
    from tagweave.sources.paths import open_path
    files, folder = open_path(os.path.join(tmpdir_run, "s", "bucket=0"))
    assert rp._answered(files, folder) == set()
    rp._save(files, folder, ["a", "b"], ["A", None])
    rp._save(files, folder, ["a", "b"], ["A", None])
    assert rp._answered(files, folder) == {"a", "b"} and len(os.listdir(folder)) == 1


def test_failed_requests_are_halved_out_and_asked_again(spark, tmpdir_run):
    log, store = os.path.join(tmpdir_run, "log"), os.path.join(tmpdir_run, "store")
    os.makedirs(log)
    df = spark.createDataFrame([(i, f"p{i}", f"m{i % 2}") for i in range(64)] + [(64, None, "m0")],
                               "id long, prompt string, model string")

    def factory(model):
        def call(prompts):
            if "p13" in prompts:
                raise RuntimeError("no")
            _log(log, [str(p) for p in prompts])
            return [f"{model}:{p}" for p in prompts]
        return call
    for _ in range(2):
        got = {r.id: r for r in hk.model_hook(df, factory, keep=["id"], by="model", store=store).collect()}
        assert len(got) == 65 and got[13].reply is None and "RuntimeError: no" in got[13].error
        assert all(r.reply == f"m{i % 2}:p{i}" and r.error is None for i, r in got.items() if i not in (13, 64))
    assert set(_asked(log).values()) == {1} and len(_asked(log)) == 64
    empty = hk.model_hook(df.limit(0), factory, keep=["id"], by="model", store=os.path.join(tmpdir_run, "other"))
    assert empty.collect() == []


def test_a_rerun_of_the_whole_curation_asks_no_model(spark, tmpdir_run):
    from tagweave.plans import stubs
    from tagweave.sources import fixtures as fx
    work = os.path.join(tmpdir_run, "work")
    args = (spark, fx.scrape_files(spark, SF_SMALL), catalog.CAPTION_MODELS, "", catalog.PRUNE_MODELS, "", "abo")
    first = sorted(map(tuple, cu.curation_run(*args, stubs.chat_stub, work_dir=work).captions.collect()))
    again = cu.curation_run(*args, stubs.no_calls, work_dir=work)
    assert first and sorted(map(tuple, again.captions.collect())) == first
    assert not [r for r in again.rejects.collect() if r.error and "answered already" in r.error]


# ---------------------------------------------------------------- caption folder

@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(cf.CaptionFolder)
    return "caption_folder"


def test_caption_folder_round_trip(spark, source, tmpdir_run):
    rows = [("a", "  x, y \n"), ("b c%20d", "é \U0001F600"), ("empty", ""), ("null", None), (None, "nameless"), ("dup", "one")]
    folder = os.path.join(tmpdir_run, "out")
    df = spark.createDataFrame(rows, "name string, text string")
    df.repartition(4).write.format(source).mode("append").save(folder)
    want = {"a": "x, y", "b c%20d": "é \U0001F600", "empty": "", "dup": "one"}
    assert {r["name"]: r["text"] for r in rd.read_captions(spark, folder).collect()} == want
    back = spark.read.format(source).option("partitions", 3).load(folder)
    assert {r["name"]: r["text"] for r in back.collect()} == want
    assert sorted(os.listdir(folder)) == sorted([f"{n}.txt" for n in want] + ["_SUCCESS"])
    # an appended caption replaces the one of its name; overwrite removes all others
    more = spark.createDataFrame([("dup", " two ")], "name string, text string")
    more.write.format(source).mode("append").option("strip", "false").save(folder)
    assert {r["name"]: r["text"] for r in spark.read.format(source).load(folder).collect()} == {**want, "dup": " two "}
    more.write.format(source).mode("overwrite").save(folder)
    assert {r["name"]: r["text"] for r in spark.read.format(source).load(folder).collect()} == {"dup": "two"}


def test_caption_folder_reads_as_s1_and_s2_do(spark, source, tmpdir_run):
    for name, data in (("ok.TXT", b"fine"), ("bad.txt", b"a\xffb"), ("other.csv", b"x"), (".hidden.txt", b"x")):
        with open(os.path.join(tmpdir_run, name), "wb") as f:
            f.write(data)
    os.makedirs(os.path.join(tmpdir_run, "sub.txt"))
    read = lambda **kw: {(r.file, r.text) for r in spark.read.format(source).options(**kw).load(tmpdir_run).collect()}
    assert read() == {("ok.TXT", "fine")} and read(lenient="true") == {("ok.TXT", "fine"), ("bad.txt", "ab")}
    assert read() == {(r.file, r.text) for r in rd.read_captions(spark, tmpdir_run).collect()}


def test_a_failed_caption_write_takes_back_its_files(spark, source, tmpdir_run):
    folder = os.path.join(tmpdir_run, "out")
    spark.createDataFrame([("kept", "before")], "name string, text string").write.format(source).mode("append").save(folder)
    bad = spark.createDataFrame([(f"n{i}", "t") for i in range(40)] + [("a/b", "no such name")], "name string, text string")
    with pytest.raises(Exception):
        bad.repartition(1).write.format(source).mode("append").save(folder)
    assert not [f for f in os.listdir(folder) if f.endswith(".part")] and "kept.txt" in os.listdir(folder)
    with pytest.raises(Exception):
        spark.createDataFrame([(1,)], "x int").write.format(source).mode("append").save(folder)
    # what tasks reported is taken back, earlier captions stay
    w = cf._Writer({"path": folder}, 0, 1, False)
    done = w.write(iter([("fresh", "x"), ("kept", "after")]))
    assert done.count == 2 and [os.path.basename(p) for p in done.fresh] == ["fresh.txt"]
    w.abort([done, None])
    assert "fresh.txt" not in os.listdir(folder) and "kept.txt" in os.listdir(folder)


# ---------------------------------------------------------------- digests of files

def test_files_are_hashed_in_pieces_and_only_where_lengths_meet(spark, tmpdir_run, monkeypatch):
    rng = random.Random(3)
    big = rng.randbytes(3 * (1 << 20) + 17)
    files = {"a 1.bin": big, "b%.bin": big, "c.bin": big[:-1] + b"\x00", "d.bin": b"", "e.bin": b"", "f.bin": b"alone", "g.bin": b"xy"}
    for name, data in files.items():
        with open(os.path.join(tmpdir_run, name), "wb") as f:
            f.write(data)
    inventory = dg.file_inventory(spark, tmpdir_run, (".bin",))
    assert "content" not in inventory.columns
    got = {r.file: r.h for r in dg.file_digests(inventory, tasks=3).collect()}
    lengths = Counter(map(len, files.values()))
    assert got == {n: hashlib.md5(d).hexdigest() if lengths[len(d)] > 1 else None for n, d in files.items()}
    action = {r.file: r.action for r in dg.keep_move(dg.file_digests(inventory)).collect()}
    assert {n for n, a in action.items() if a == "move"} == {"b%.bin", "e.bin"} and len(action) == len(files)
    # a file of unique length is never opened
    gone = inventory.withColumn("path", F.when(F.col("file") == "f.bin", F.lit("/nowhere")).otherwise(F.col("path")))
    assert dg.file_digests(gone).count() == len(files)
    assert dg.file_digests(inventory.limit(0)).collect() == []


# ---------------------------------------------------------------- records of exports

def _records_file(folder, name, rows, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(rows)
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(out.getvalue())
    return path


@pytest.mark.parametrize("end,split", [("\n", None), ("\n", 64), ("\r\n", 50), ("\n", 1000)])
def test_records_with_quoted_line_breaks_across_splits(spark, tmpdir_run, end, split):
    rng = random.Random(split or 1)
    odd = ["x\ny", 'say "hi"', "a,b", "", "\n", "plain", "é\U0001F600", '"', "long " * 30 + "\nend"]
    rows = [["id", "name", "note"]] + [[str(i), rng.choice(odd), rng.choice(odd)] for i in range(400)]
    path = _records_file(tmpdir_run, "r.csv", rows, end)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_records(spark, path).orderBy("record_no").collect()
        assert [r.record_no for r in got] == list(range(len(rows)))
        assert [next(csv.reader(io.StringIO(r.record, newline=""))) for r in got] == rows
        if split == 64:
            assert spark.read.text(path).rdd.getNumPartitions() > 50
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_exports_keep_quoted_line_breaks_and_row_numbers(spark, tmpdir_run):
    alias = _records_file(tmpdir_run, "a.csv", [["id", "antecedent_name", "consequent_name"], ["1", "x\ny", "z"], ["2", "p", "q\nr"],
                                                ["3", "p", "last"]], "\n")
    rows = [(r.row_no, r.antecedent_name, r.consequent_name) for r in rd.read_alias_rows(spark, alias, None).collect()]
    assert sorted(rows) == [(1, "x\ny", "z"), (2, "p", "q\nr"), (3, "p", "last")]
    assert {r[0]: r[1] for r in dic.alias_map(rd.read_alias_rows(spark, alias, None)).collect()} == {"x\ny": "z", "p": "last"}
    d = _records_file(tmpdir_run, "d.csv", [["id", "name", "category", "post_count"], ["1", "two\nlines", "0", "5"],
                                            ["2", "NA", "4", "7"]], "\r\n")
    assert sorted(map(tuple, rd.read_dictionary(spark, d).collect())) == [("NA", 4, 7), ("two\nlines", 0, 5)]
    labels = _records_file(tmpdir_run, "l.csv", [["tag", "n"], ["a_b\nc", "1"], ["d", "2"]], "\n")
    assert [(r.idx, r.tag) for r in rd.read_label_file(spark, labels, "m").orderBy("idx").collect()] == [(0, "a b\nc"), (1, "d")]
