"""File readers, sinks, hooks and batch = stream, on small trees written
into a fresh temporary folder per test."""

import datetime as dt
import json
import os
import time

from pyspark.sql import functions as F

from tagweave.functions import text as tx
from tagweave.operators import dictionary as dic
from tagweave.operators import hooks as hk
from tagweave.plans import curation as cu
from tagweave.sources import files as rd
from tagweave.sources import sinks
from tagweave.streaming import captions as stc


def _write(folder, name, data, mode="w"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), mode) as fh:
        fh.write(data)


def test_read_captions_suffix_and_bad_bytes(spark, tmpdir_run):
    d = os.path.join(tmpdir_run, "caps")
    _write(d, "a.txt", "x, y")
    _write(d, "B.TXT", "z")
    _write(d, "c.png", "not a caption")
    _write(d, "bad.txt", b"ok\xff\xfe, tag", "wb")
    _write(os.path.join(d, "sub"), "deep.txt", "w")
    strict = {r["name"]: r["text"] for r in rd.read_captions(spark, d).collect()}
    assert strict == {"a": "x, y", "B": "z"}  # undecodable file skipped, no recursion
    lenient = {r["name"]: r["text"] for r in rd.read_captions(spark, d, recursive=True, lenient=True).collect()}
    assert lenient["bad"] == "ok, tag" and lenient["deep"] == "w"


def test_read_caption_sources_dedups_folders(spark, tmpdir_run):
    a, b = os.path.join(tmpdir_run, "a"), os.path.join(tmpdir_run, "b")
    _write(a, "n.txt", "x")
    _write(b, "n.txt", "y")
    s = rd.read_caption_sources(spark, [a, b, a])
    assert sorted((r["source_ord"], r["text"]) for r in s.collect()) == [(0, "x"), (1, "y")]


def test_read_images_and_dictionary_csv(spark, tmpdir_run):
    d = os.path.join(tmpdir_run, "img")
    _write(d, "a.PNG", b"\x89PNG", "wb")
    _write(d, "b.tif", b"II*", "wb")
    _write(d, "c.txt", "x")
    got = {r["file"] for r in rd.read_images(spark, d).collect()}
    assert got == {"a.PNG"}
    got = {r["file"] for r in rd.read_images(spark, d, exts=(".png", ".tif"), with_content=False).collect()}
    assert got == {"a.PNG", "b.tif"}
    csv = os.path.join(tmpdir_run, "tags-2024-01-01.csv")
    _write(tmpdir_run, "tags-2024-01-01.csv", 'id,name,category,post_count,extra\n1,NA,0,5,x\n2,"a,b",4,0,y\n3,null,1,2,z\n')
    rows = {r["name"]: (r["category"], r["post_count"]) for r in rd.read_dictionary(spark, csv).collect()}
    assert rows == {"NA": (0, 5), "a,b": (4, 0), "null": (1, 2)}


def test_alias_readers_and_snapshot(spark, tmpdir_run):
    _write(tmpdir_run, "tag_aliases-2024-03-01.csv", "id,alias_name,consequent_name\n1,kitty,cat\n2,kitty,kitten\n")
    _write(tmpdir_run, "tag_implications-2024-03-01.csv", "id,antecedent_name,consequent_name\n1,cat,felid\n")
    _write(tmpdir_run, "tag_aliases-2023-01-01.csv", "id,antecedent_name,consequent_name\n1,old,x\n")
    path, stale = rd.latest_snapshot(spark, tmpdir_run, "tag_aliases-", dt.date(2024, 4, 1))
    assert path.endswith("tag_aliases-2024-03-01.csv") and not stale
    _, stale = rd.latest_snapshot(spark, tmpdir_run, "tag_aliases-", dt.date(2024, 5, 30))
    assert stale  # 90 days old: still used, flagged stale
    rows = rd.read_alias_rows(spark, path, os.path.join(tmpdir_run, "tag_implications-2024-03-01.csv"))
    m = {r[0]: r[1] for r in dic.alias_map(rows).collect()}
    assert m == {"kitty": "kitten", "cat": "felid"}


def test_post_meta_file(spark, tmpdir_run):
    _write(tmpdir_run, "meta.json", json.dumps({"1": {"artist": "A", "year": 2001, "filename": "f"}, "x": [1]}))
    rows = [tuple(r) for r in rd.read_post_meta_files(spark, os.path.join(tmpdir_run, "meta.json")).collect()]
    assert rows == [("meta.json", 0, "1", "A", "2001", "f")]


def test_label_files(spark, tmpdir_run):
    _write(tmpdir_run, "obj.json", json.dumps({"a_b": 0, "c": 2}))
    _write(tmpdir_run, "lst.json", json.dumps(["x_y", "z"]))
    _write(tmpdir_run, "hdr.csv", "id,name,count\n1, tag_one ,5\n2,two,3\n")
    _write(tmpdir_run, "nohdr.csv", "first,alpha\nsecond,beta\n")
    _write(tmpdir_run, "skip.csv", "h0,h1\n1,l_one\n2,l_two\n")

    def labels(name, **kw):
        return [(r["idx"], r["tag"]) for r in rd.read_label_file(spark, os.path.join(tmpdir_run, name), "m", **kw)
                .orderBy("idx").collect()]
    assert labels("obj.json") == [(0, "a b"), (1, ""), (2, "c")]
    assert labels("lst.json") == [(0, "x y"), (1, "z")]
    assert labels("hdr.csv") == [(0, "tag one"), (1, "two")]
    assert labels("nohdr.csv", column=1) == [(0, "alpha"), (1, "beta")]
    assert labels("skip.csv", column=1, skip_first_line=True) == [(0, "l one"), (1, "l two")]


def test_registry_defaults(spark, tmpdir_run):
    _write(tmpdir_run, "reg.json", json.dumps({
        "m1": {"num_classes": 10, "tags_file": "t.json", "head_type": "gated", "supports_cam": True},
        "m2": {"num_classes": 5, "tags_file": "t.csv", "head_type": "linear", "supports_cam": False, "backend": "onnx",
               "use_column_number": 1, "skip_first_line": True},
        "m3": {"num_classes": 3, "tags_file": "t.json", "head_type": "linear"}}))
    reg = rd.read_registry(spark, os.path.join(tmpdir_run, "reg.json"))
    r = {x["model"]: x for x in reg.collect()}
    assert r["m1"]["backend"] == "pytorch" and r["m2"]["backend"] == "onnx"
    assert r["m3"]["supports_cam"] is True and r["m3"]["use_column_number"] == 0
    assert {x["model"] for x in rd.capable_models(reg).collect()} == {"m1", "m3"}


def test_model_list_parse(spark):
    texts = ['[{"model": "a/x", "prompt": "p"}, {"model": ""}, 3, {"other": 1}]', "a/x, b/y\nc/z", "  ", "[bad"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(m["model"], m["prompt"]) for m in r["c"]] for r in df.select(cu.parse_model_list(F.col("t")).alias("c")).collect()]
    assert got[0] == [("a/x", "p")]
    assert got[1] == [("a/x", None), ("b/y", None), ("c/z", None)]
    assert got[2] == []
    assert got[3] == [("[bad", None)]


def test_sinks_roundtrip(spark, tmpdir_run):
    df = spark.createDataFrame([("a", "  x, y \n"), ("b", "z")], "name string, text string")
    p = sinks.write_version(df, os.path.join(tmpdir_run, "stage"), 1, strip=True)
    back = {r["name"]: r["text"] for r in spark.read.parquet(p).collect()}
    assert back == {"a": "x, y", "b": "z"}
    out = os.path.join(tmpdir_run, "export")
    sinks.export_caption_text(df, out)
    assert {r["name"]: r["value"] for r in spark.read.text(out).collect()} == {"a": "x, y", "b": "z"}
    bm = spark.createDataFrame([("v/alpha", "a", "t1"), ("w/alpha", "a", "t2")], "model string, name string, text string")
    sinks.write_by_model(bm, os.path.join(tmpdir_run, "bymodel"))
    parts = sorted(x for x in os.listdir(os.path.join(tmpdir_run, "bymodel")) if x.startswith("model="))
    assert parts == ["model=v%2Falpha", "model=w%2Falpha"]  # same last part, two vendors


def test_hooks_isolate_failures(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "boom"), ("c", "fine")], "k string, prompt string")

    def call(prompts):
        if "boom" in prompts:
            raise RuntimeError("model refused")
        return [p.upper() for p in prompts]
    r = {x["k"]: (x["reply"], x["error"]) for x in hk.model_hook(df, call, keep=["k"]).collect()}
    assert r["a"] == ("OK", None) and r["c"] == ("FINE", None)
    assert r["b"][0] is None and "model refused" in r["b"][1]
    good, bad = hk.split_quarantine(hk.model_hook(df, call, keep=["k"]))
    assert good.count() == 2 and bad.count() == 1
    t = hk.apply_transform(df, lambda c: F.upper(c), "prompt")
    assert {x["prompt"] for x in t.collect()} == {"OK", "BOOM", "FINE"}
    t = hk.apply_python_transform(df, lambda s: s[1:3], "prompt")
    assert {x["prompt"] for x in t.collect()} == {"k", "oo", "in"}
    short = hk.model_hook(df, lambda ps: [p.upper() for p in ps][:1], keep=["k"])  # too few replies to a batch
    assert {x["k"]: x["reply"] for x in short.collect()} == {"a": "OK", "b": "BOOM", "c": "FINE"}
    none = hk.model_hook(df, lambda ps: [], keep=["k"])
    assert all("0 replies to 1 prompts" in x["error"] for x in none.collect())


def test_batch_equals_stream(spark, tmpdir_run):
    d = os.path.join(tmpdir_run, "incoming")
    texts = {"a": "meta:x, y, y <|eot_id|>", "b": "cat, kitty, 2014", "c": ""}
    for k, v in texts.items():
        _write(d, f"{k}.txt", v)
    dic_df = spark.createDataFrame([("cat", 0, 3), ("kitten", 0, 2), ("y", 0, 1)], "name string, category int, post_count bigint")
    amap = spark.createDataFrame([("kitty", "kitten")], "antecedent_name string, consequent_name string")

    batch = rd.read_captions(spark, d)
    assert {r["name"] for r in batch.collect()} == set(texts)
    batch = batch.where("text != ''")  # a stream of files never sees one of no bytes
    want_clean = {r["name"]: r["c"] for r in batch.select("name", tx.basic_clean("text").alias("c")).collect()}
    want_san = {r["name"]: r["text"] for r in dic.sanitize(batch, dic_df, amap).collect()}

    s = stc.caption_stream(spark, d).select("name", tx.basic_clean("text").alias("c"))
    q = s.writeStream.format("memory").queryName("clean_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got_clean = {r["name"]: r["c"] for r in spark.sql("SELECT * FROM clean_out").collect()}
    assert got_clean == want_clean

    out = os.path.join(tmpdir_run, "sanitized")
    q = stc.run_per_batch(stc.caption_stream(spark, d), lambda b: dic.sanitize(b, dic_df, amap), out, "sanitize_test",
                          checkpoint=os.path.join(tmpdir_run, "ckpt"))
    q.awaitTermination(120)
    time.sleep(0.5)
    got_san = {r["name"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert got_san == want_san


def test_model_hook_calls_parts_of_bounded_size(spark):
    df = spark.createDataFrame([(i, "mab"[i % 3], ("x%03d" % i) * 20_000) for i in range(60)], "k int, model string, prompt string").coalesce(1)

    def call(ps):
        return [f"{len(ps)} {sum(map(len, ps))} {p[:4]}" for p in ps]

    for by, fn in ((None, call), ("model", lambda key: call)):
        got = [(r["k"], r["reply"].split(), r["error"]) for r in hk.model_hook(df, fn, keep=["k"], by=by).collect()]
        assert [(k, r[2], e) for k, r, e in got] == [(i, "x%03d" % i, None) for i in range(60)]
        assert max(int(r[1]) for _, r, _ in got) <= hk.PART_BYTES and max(int(r[0]) for _, r, _ in got) > 1


def test_a_local_folder_is_listed_one_file_after_the_other(tmpdir_run, monkeypatch):
    from tagweave.sources import paths
    os.mkdir(f"{tmpdir_run}/sub")
    for i in range(30):
        with open(f"{tmpdir_run}/{'sub/' if i % 3 == 0 else ''}f{i}.txt", "w") as f:
            f.write("x" * i)
    files, at = paths.open_path(tmpdir_run)
    want = {r: {(i.path, i.base_name, i.size) for i in files.get_file_info(paths.pafs.FileSelector(at, recursive=r))
                if i.type == paths.pafs.FileType.File} for r in (False, True)}
    for r in (False, True):
        found = paths.listed(files, at, r)
        assert iter(found) is found and set(found) == want[r] and len(want[r]) == (30 if r else 20)


def test_model_hook_dispatches_by_model(spark):
    df = spark.createDataFrame([("m1", "a"), ("m2", "b"), ("m1", "c"), ("m2", "bad")], "model string, prompt string")

    def factory(model):
        def call(prompts):
            if "bad" in prompts:
                raise ValueError("no")
            return [f"{model}:{p}" for p in prompts]
        return call
    r = {(x["model"], x["reply"], x["error"] is not None) for x in hk.model_hook(df, factory, keep=["model"], by="model").collect()}
    assert r == {("m1", "m1:a", False), ("m2", "m2:b", False), ("m1", "m1:c", False), ("m2", None, True)}


def test_label_and_alias_files_follow_file_order(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "order")
    _write(path, "l.json", '{"zeta": 1, "alpha": 1, "b_c": 0}')
    got = {r["idx"]: r["tag"] for r in rd.read_label_file(spark, os.path.join(path, "l.json"), "m").collect()}
    assert got == {0: "b c", 1: "alpha"}  # the last tag of a repeated index, not the greatest
    _write(path, "a.csv", "id,antecedent_name,consequent_name\n1,x,late\n2,\"q,r\",s\n3,x,early\n")
    rows = rd.read_alias_rows(spark, os.path.join(path, "a.csv"), None).collect()
    assert sorted((r["row_no"], r["antecedent_name"], r["consequent_name"]) for r in rows) == [
        (1, "x", "late"), (2, "q,r", "s"), (3, "x", "early")]
    assert {r[0]: r[1] for r in dic.alias_map(rd.read_alias_rows(spark, os.path.join(path, "a.csv"), None)).collect()}["x"] == "early"


def test_stack_sources_counts_a_source_once(spark):
    a, b = (spark.createDataFrame([(f"{k}.txt", k, k)], "file string, name string, text string") for k in "ab")
    got = sorted((r["source"], r["source_ord"], r["name"]) for r in rd.stack_sources([("s1", a), ("s2", b), ("s1", b)]).collect())
    assert got == [("s1", 0, "a"), ("s2", 1, "b")]
