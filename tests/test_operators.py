"""Golden rows for the dictionary, merge, post, score, file and review
operators, and plan checks."""

from pyspark.sql import functions as F

from tagweave.operators import dictionary as dic
from tagweave.operators import files as fl
from tagweave.operators import heat as ht
from tagweave.operators import merge as mg
from tagweave.operators import posts as po
from tagweave.operators import prune as pn
from tagweave.operators import review as rv
from tagweave.operators import scores as sc
from tagweave.sources.fixtures import small_table


def _dictionary(spark):
    return spark.createDataFrame(
        [("cat", 0, 5), ("dog", 0, 3), ("animal", 0, 9), ("pet", 1, 2), ("alice", 4, 8), ("dead", 0, 0),
         ("2014", 0, 1), ("4leg", 0, 4), ("lore_x", 7, 3), ("kitten", 0, 0), ("felid", 5, 2)],
        "name string, category int, post_count bigint")


def _aliases(spark):
    return spark.createDataFrame(
        [("kitty", "cat", 1, 1), ("kitty", "kitten", 1, 2),          # last alias row wins -> kitten
         ("cat", "felid", 2, 1),                                     # implication replaces cat
         ("puppy", "dog", 1, 1), ("puppy", "animal", 2, 1),          # implication beats alias
         ("doggo", "puppy", 1, 1)],                                  # one hop only: doggo -> puppy
        "antecedent_name string, consequent_name string, kind int, row_no bigint")


def test_alias_map_rules(spark):
    m = {r[0]: r[1] for r in dic.alias_map(_aliases(spark)).collect()}
    assert m == {"kitty": "kitten", "cat": "felid", "puppy": "animal", "doggo": "puppy"}


def test_sanitize_golden(spark):
    caps = spark.createDataFrame(
        [("a", "cat, dog, pet, alice, 2014, 4leg, unknown, dog <|eot_id|> "),
         ("b", "kitty, puppy, doggo, lore_x"),
         ("c", "dead, unknown"),
         ("d", "")],
        "name string, text string")
    out = {r[0]: r[1] for r in dic.sanitize(caps, _dictionary(spark), dic.alias_map(_aliases(spark))).collect()}
    # cat -> felid (category 5 kept); pet (1) and alice (4) dropped; years dropped; unknown dropped
    assert out["a"] == "felid, dog"
    # kitty -> kitten (dead, dropped); puppy -> animal; doggo -> puppy (unknown after one hop); lore dropped
    assert out["b"] == "animal"
    assert out["c"] == "" and out["d"] == ""   # every name stays


def _ran(df):
    """The plan that ran, after adaptive execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sanitize_joins_by_measured_size_and_regroups_once(spark, monkeypatch):
    from tagweave.operators import lookup as lk
    caps = spark.createDataFrame([("a", "cat, dog")], "name string, text string")
    df = dic.sanitize(caps, _dictionary(spark), dic.alias_map(_aliases(spark)))
    plan = _ran(df).split("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan  # small sides, as measured
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    same = sorted(tuple(r) for r in df.collect())
    # both sides were measured; with each beyond the bound nothing of their size is broadcast
    measured = []
    monkeypatch.setattr(lk, "table_bytes", lambda t: measured.append(t.columns) or (1 << 40))
    off = dic.sanitize(caps, _dictionary(spark), dic.alias_map(_aliases(spark)))
    assert sorted(tuple(r) for r in off.collect()) == same and measured == [["_ante", "_cons"], ["_name", "_cat"]]


def test_merge_captions_order_and_empty(spark):
    src = spark.createDataFrame(
        [("a", "x, y <|eot_id|>", 0), ("a", "y, z", 1), ("b", "", 0), ("c", "q", 1), ("b", "w", 1)],
        "name string, text string, source_ord int")
    out = {r[0]: r[1] for r in mg.merge_captions(src).collect()}
    assert out == {"a": "x, y, z", "b": ", w", "c": "q"}
    # merging a source with itself = de-dup
    one = spark.createDataFrame([("a", "x, x, y", 0), ("a", "x, x, y", 1)], "name string, text string, source_ord int")
    assert mg.merge_captions(one).first()["text"] == "x, y"


def test_merge_priority_orders_by_code_text(spark):
    d = _dictionary(spark)
    src = spark.createDataFrame([("n", "dog, alice , meta:m, felid", 0), ("n", "dog, rating:s, pet, 2014", 1)],
                                "name string, text string, source_ord int")
    out = mg.merge_priority(src, d).first()["text"]
    # art (pet) < char (alice) < gen (dog) < meta (meta:m, 2014) < rate < spec (felid)
    assert out == "pet, alice, dog, meta:m, 2014, rating:s, felid"


def test_keep_only_character(spark):
    d = spark.createDataFrame([("alice", 4, 3), ("bob", 4, 3), ("cat", 0, 1)], "name string, category int, post_count bigint")
    caps = spark.createDataFrame([("n", "cat, Bob, alice, cat, , bob")], "name string, text string")
    out = mg.keep_only_character(caps, d, " BOB ").first()["text"]
    assert out == "Bob, bob, cat, cat"


def test_inject_posts_in_order_and_counts(spark):
    caps = spark.createDataFrame([("f1", "a, b"), ("f2", "solo")], "name string, text string")
    posts = spark.createDataFrame(
        [(1, "f1", "Ann", "2001"), (2, "f1", "Bo", "2002"), (3, "f1", "ann", "2001"), (4, "f9", "X", "1"),
         (5, "f2", "", "2000"), (6, "f2", "Cy", " 2003 ")],
        "post_id long, filename string, artist string, year string")
    out = {r[0]: (r[1], r[2]) for r in po.inject_posts(posts, caps).collect()}
    assert out["f1"] == ("a, bo, 2002, ann, 2001, b", 2)
    assert out["f2"] == ("cy, 2003, solo", 1)
    s = po.inject_posts_summary(posts, caps).first().asDict()
    assert s == {"modified": 3, "missing": 1, "skipped": 1}


def test_inject_posts_applies_every_repeat(spark):
    caps = spark.createDataFrame([("f", "a, b")], "name string, text string")
    posts = spark.createDataFrame([(i, "f", "Foo (artist)", "2014") for i in range(3)],
                                  "post_id long, filename string, artist string, year string")
    r = po.inject_posts(posts, caps).first()
    assert r["text"] == "a, " + "foo (artist), 2014, " * 3 + "b" and r["n_modified"] == 3


def test_post_meta_feeds_the_injector_in_json_order(spark):
    t = spark.createDataFrame([("f2.json", '{"1": {"artist": "C", "year": 3, "filename": "f"}}'),
                               ("f1.json", '{"9": {"artist": "A", "year": 1, "filename": "f"}, '
                                           '"2": {"artist": "B", "year": 2, "filename": "f"}}')], "file string, text string")
    caps = spark.createDataFrame([("f", "x, y")], "name string, text string")
    out = po.inject_posts(po.parse_post_meta(t, keep=("file",)), caps, order=("file", "post_no")).first()
    assert (out["text"], out["n_modified"]) == ("x, c, 3, b, 2, a, 1, y", 3)


def test_post_meta_drops_non_objects(spark):
    t = spark.createDataFrame([('{"1": {"artist": "A", "year": 2001, "filename": "f"}, "2": 5, "3": "x", '
                                '"4": {"artist": null, "year": "2", "filename": "g"}}',)], "text string")
    rows = sorted(tuple(r) for r in po.parse_post_meta(t).collect())
    assert rows == [(0, "1", "A", "2001", "f"), (3, "4", None, "2", "g")]


def test_topk_ties_and_dup_labels(spark):
    s = spark.createDataFrame([(1, "m", 0, [5, 9, 9, 1, 7])], "image long, model string, model_ord int, scores array<bigint>")
    vocab = spark.createDataFrame([("m", 0, "a"), ("m", 1, "b"), ("m", 2, "dup"), ("m", 3, "c"), ("m", 4, "dup")],
                                  "model string, idx int, tag string")
    top = s.select(sc.topk(F.col("scores"), 3).alias("t")).first()["t"]
    assert [x["idx"] for x in top] == [1, 2, 4]  # ties by index
    r = sc.attach_labels(s.select("image", "model", sc.topk(F.col("scores"), 5).alias("top")), vocab)
    d = r.select(sc.dedup_labels("top").alias("d")).first()["d"]
    # "dup" sits at its best place (rank of 9) with its lowest score (7)
    assert [(x["tag"], x["score"], x["rank"]) for x in d] == [("b", 9, 0), ("dup", 7, 1), ("a", 5, 2), ("c", 1, 3)]
    out = sc.batch_tag(s, vocab, threshold=6e-6, k=5).first()["text"]
    assert out == "b, dup"


def test_batch_tag_has_no_shuffle_on_scores(spark):
    s = spark.createDataFrame([(1, "m", 0, [5, 9])], "image long, model string, model_ord int, scores array<bigint>")
    vocab = small_table(spark, [("m", 0, "a"), ("m", 1, "b")], ["model", "idx", "tag"])
    plan = _ran(sc.batch_tag(s, vocab, 0.0)).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan


def test_ensemble_mean_over_returning_models(spark):
    s = spark.createDataFrame([(1, "m1", 0, [600000, 100000]), (1, "m2", 1, [300000])],
                              "image long, model string, model_ord int, scores array<bigint>")
    vocab = spark.createDataFrame([("m1", 0, "x"), ("m1", 1, "y"), ("m2", 0, "x")], "model string, idx int, tag string")
    e = {r["tag"]: (r["sum_micro"], r["n_models"]) for r in sc.ensemble(s, vocab).collect()}
    assert e == {"x": (900000, 2), "y": (100000, 1)}
    t = sc.ensemble_tag_string(sc.ensemble(s, vocab), 0.05).first()["text"]
    assert t == "x, y"


def test_gated_and_blocked_heads_agree(spark):
    import numpy as np
    emb = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, [0.0, 1.0, 0.0])], "vec_id long, embedding array<float>")
    r = spark.range(12)
    w = r.select((F.col("id") / 3).cast("int").alias("l"), (F.col("id") % 3).cast("int").alias("e"))
    w = w.select("l", "e", ((F.col("l") + 1) * (F.col("e") - 1)).cast("double").alias("w"))
    a = {r["image"]: r["scores"] for r in sc.dense_scores(emb, w, head="linear").collect()}
    b = {r["image"]: r["scores"] for r in sc.dense_scores(emb, w, head="linear", block=3).collect()}
    g = {r["image"]: r["scores"] for r in sc.dense_scores(emb, w, head="gated").collect()}
    for k in a:
        assert np.allclose(a[k], b[k])
        assert np.allclose(g[k], np.array(a[k][:2]) * np.array(a[k][2:]))
    # a label without weight rows in the middle and at the end of a block; string image ids keep their type
    files = emb.select(F.concat(F.lit("img_"), "vec_id").alias("vec_id"), "embedding")
    sparse = w.where("l <> 1")
    c = {r["image"]: r["scores"] for r in sc.dense_scores(files, sparse, block=2).collect()}
    assert set(c) == {"img_1", "img_2"}
    assert np.allclose(c["img_1"], [a[1][0], 0.5, *a[1][2:]])
    best = sc.dense_scores(files, w, top=2).where("image = 'img_1'").first()["scores"]
    assert [x["idx"] for x in best] == sorted(range(4), key=lambda i: (-a[1][i], i))[:2]


def test_stored_head_is_read_by_tasks(spark, tmp_path, monkeypatch):
    """Blocks are files that tasks read; a stored head serves again, no block need stay in memory, nothing is broadcast."""
    import numpy as np
    from tagweave.operators import scores as sc
    rng = np.random.default_rng(5)
    mat = rng.normal(size=(23, 4))
    mat[10:15] = 0  # the third block of five has no rows
    rows = [(l, e, float(mat[l, e])) for l in range(23) for e in range(4) if mat[l, e]]
    w = spark.createDataFrame([*rows, (None, 1, 2.0), (3, 1, None), (3, 2, -99.0)], "l int, e int, w double")
    stored = sc.store_head(w, block=5, folder=str(tmp_path))
    assert (stored.n_labels, stored.n_dims, stored.block) == (23, 4, 5)
    assert sorted(p.name for p in next(tmp_path.iterdir()).glob("block=*")) == [f"block={n}" for n in (0, 1, 3, 4)]
    assert np.array_equal(np.vstack(list(stored.blocks({}))), mat)
    x = rng.normal(size=(40, 4))
    emb = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = 1 / (1 + np.exp(-(x @ mat.T)))
    for stored.keep in (0, 320, sc.KEPT_BYTES):  # none, two and all of the blocks stay in memory
        got = {r["image"]: r["scores"] for r in sc.dense_scores(emb, stored).collect()}
        assert np.allclose([got[i] for i in range(40)], want)
    assert "Exchange" not in sc.dense_scores(emb, stored)._jdf.queryExecution().toString()
    monkeypatch.setattr(sc, "BLOCK_BYTES", 64)  # two labels of four dims
    assert sc.store_head(w).block == 2
    assert sc.dense_scores(emb, w.limit(0)).first()["scores"] == []


def test_grid_and_mask(spark):
    df = spark.createDataFrame([(n,) for n in [1, 12, 729, 13, 48]], "n int")
    got = [(r["g"]["h"], r["g"]["w"]) for r in df.select(ht.grid_layout(F.col("n")).alias("g")).collect()]
    assert got == [(1, 1), (3, 4), (27, 27), (1, 13), (6, 8)]
    m = spark.createDataFrame([(2, 10), (1, 10), (0, 0)], "num long, den long")
    assert [r[0] for r in m.select(ht.heat_mask(F.col("num"), F.col("den"), 0.2, 0.6)).collect()] == [153, 0, 0]
    # a flat map has the value 0: only a threshold of 0 paints it
    assert [r[0] for r in m.select(ht.heat_mask(F.col("num"), F.col("den"), 0.0, 0.6)).collect()] == [153, 153, 153]


def test_dedup_keep_move_with_a_hot_hash(spark):
    files = spark.createDataFrame([(f"f{i:03d}.png", bytearray(b"same")) for i in range(30)] +
                                  [("g.png", bytearray(b"other"))], "file string, content binary")
    acts = {r["file"]: r["action"] for r in fl.dedup_keep_move(files).collect()}
    assert acts["f000.png"] == "keep" and acts["g.png"] == "keep"
    assert sum(a == "move" for a in acts.values()) == 29
    g = {r["keep"]: r["extra"] for r in fl.dedup_groups(files).collect()}
    assert g == {"f000.png": 29, "g.png": 0}


def test_pair_and_ensure(spark):
    caps = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    imgs = spark.createDataFrame([("a.jpg",), ("a.png",), ("b.JPG",), ("b.webp",), ("c.gif",)], "file string")
    assert sorted(tuple(r) for r in fl.pair_files(caps, imgs).collect()) == [("a.txt", "a.png"), ("b.txt", "b.webp")]
    own = spark.createDataFrame([("c.tiff",)], "file string")
    e = {r["stem"]: (r["image"], r["origin"]) for r in fl.ensure_images(caps, own, imgs).collect()}
    assert e == {"a": ("a.png", "raw"), "b": ("b.webp", "raw"), "c": ("c.tiff", "own")}


def test_guard_and_remove(spark):
    df = spark.createDataFrame([(["Cat", "dog", "cat", "ghost"], ["cat", "Dog", "cat", "x"])],
                               "proposed array<string>, tags array<string>")
    df = df.withColumn("tl", F.transform("tags", F.lower))
    r = pn.guard(df, "proposed", "tl", "g").first()["g"]
    assert r == ["Cat", "dog", "cat"]
    kept = df.select(pn.remove_tags(F.col("tags"), F.array(F.lit("cat"))).alias("k")).first()["k"]
    assert kept == ["Dog", "x"]


def test_review_and_edits(spark):
    imgs = spark.createDataFrame([("a.png",), ("b.jpg",), ("c.txt",)], "file string")
    mc = spark.createDataFrame([("m1", "a", "z, y"), ("m2", "a", "y, x ,"), ("m1", "b", "q")], "model string, name string, text string")
    r = {x["image"]: (x["union"], dict(x["by_model"])) for x in rv.review_items(imgs, mc).collect()}
    assert r["a.png"] == (["x", "y", "z"], {"m1": ["z", "y"], "m2": ["y", "x"]})
    assert r["b.jpg"] == (["q"], {"m1": ["q"]})
    stored = spark.createDataFrame([("a", "old"), ("b", "keep")], "name string, text string")
    edits = spark.createDataFrame([("a", "new"), ("c", "added")], "name string, text string")
    assert sorted(tuple(x) for x in rv.apply_edits(stored, edits).collect()) == [("a", "new"), ("b", "keep"), ("c", "added")]


def test_review_edges(spark):
    imgs = spark.createDataFrame([("a.png",), ("b.jpg",)], "file string")
    schema = "model string, name string, text string"
    # two captions of one (model, name): one of them counts, the job goes on
    r = rv.review_items(imgs, spark.createDataFrame([("m", "a", "q"), ("m", "a", "p")], schema)).where("image = 'a.png'").first()
    assert (r["union"], dict(r["by_model"])) == (["p"], {"m": ["p"]})
    merged = spark.createDataFrame([("a", "x, y")], "name string, text string")
    r = {x["image"]: (x["union"], dict(x["by_model"])) for x in rv.review_items(imgs, spark.createDataFrame([], schema), merged).collect()}
    assert r == {"a.png": (["x", "y"], {}), "b.jpg": ([], {})}  # nothing written by models: the merged captions
    r = rv.review_items(imgs, spark.createDataFrame([("m", "a", "q")], schema), merged).where("image = 'a.png'").first()
    assert r["union"] == ["q"]


def test_finalize_keeps_a_caption_once(spark):
    review = spark.createDataFrame([("a", "x"), ("b", "abo, y")], "name string, text string")
    imgs = spark.createDataFrame([("a.png",), ("a.jpg",), ("c.png",)], "file string")
    f = rv.finalize(review, imgs, "abo")
    assert sorted((r["stem"], r["text"], r["images"]) for r in f.collect()) == [
        ("a", "abo, x", ["a.jpg", "a.png"]), ("b", "abo, y", []), ("c", None, ["c.png"])]
    assert rv.finalize_summary(f).first().asDict() == {"captions": 2, "images": 3}


def test_curation_run_calls_each_model_once_per_record(spark, tmpdir_run):
    """Calls are counted in files that the stand-in model writes (this test runs on one machine)."""
    import json
    import os
    import uuid
    from tagweave.plans import curation as cu
    log = os.path.join(tmpdir_run, "calls")
    os.makedirs(log)

    def factory(model):
        def call(requests):
            with open(os.path.join(log, uuid.uuid4().hex), "w", encoding="utf-8") as fh:
                fh.write("\n".join([model] * len(requests)))
            return ["" if "img_3." in r else f"- {model} {json.loads(r)[1]['content'][0]['text'][:5]}, solo" for r in requests]
        return call
    files = spark.createDataFrame([(f"img_{i}.png", None) for i in range(10)] + [("img_1.json", "{bad")], "file string, text string")
    run = cu.curation_run(spark, files, [{"model": "v/a"}, {"model": "w/a"}], "", [{"model": "v/p"}], "", "abo", factory,
                          work_dir=os.path.join(tmpdir_run, "stages"))
    caps = {r["name"]: r["text"] for r in run.captions.collect()}
    rejects = sorted((r["stage"], r["model"] or "", r["item"], r["error"]) for r in run.rejects.collect())
    run.captions.count(), run.rejects.count()
    calls = [m for f in os.listdir(log) for m in open(os.path.join(log, f), encoding="utf-8").read().split("\n")]
    assert {m: calls.count(m) for m in set(calls)} == {"v/a": 10, "w/a": 10, "v/p": 9}
    assert len(caps) == 9 and all(t.startswith("abo, ") for t in caps.values())
    assert [r[:3] for r in rejects] == [("caption", "v/a", "img_3.png"), ("caption", "w/a", "img_3.png"), ("ingest", "", "img_1.png")]


def test_models_of_two_vendors_stay_apart(spark):
    from tagweave.plans import curation as cu
    stage = spark.createDataFrame([(0, "v/a", "s", "one", None), (1, "w/a", "s", "two", None), (2, "v/a", "s", "three", None)],
                                  "cfg int, model string, stem string, text string, error string")
    got = sorted((r["source_ord"], r["source"], r["text"]) for r in cu._as_sources(stage).collect())
    assert got == [(0, "v/a", "three"), (1, "w/a", "two")]


def test_sanitize_on_bucketed_captions_needs_no_regroup_shuffle(spark, tmpdir_run):
    import os
    caps = spark.createDataFrame([(f"n{i}", "cat, dog, kitty") for i in range(20)], "name string, text string")
    caps.write.bucketBy(4, "name").option("path", os.path.join(tmpdir_run, "caps")).saveAsTable("caps_bucketed_t")
    d = small_table(spark, [tuple(r) for r in _dictionary(spark).collect()], ["name", "category", "post_count"])
    a = small_table(spark, [tuple(r) for r in _aliases(spark).collect()],
                    ["antecedent_name", "consequent_name", "kind", "row_no"])
    out = dic.sanitize(spark.table("caps_bucketed_t"), d, dic.alias_map(a))
    # literal tables: their size is known when the plan is made
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(name" not in plan  # the buckets already hold a name's rows together
        assert {r["text"] for r in out.collect()} == {"felid, dog"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sql("DROP TABLE caps_bucketed_t")


def test_restore_names_collisions(spark):
    files = spark.createDataFrame([("clip_frame_1-up.png",), ("clip_frame_1-down.png",), ("a=1-x.TXT",), ("plain.jpg",)],
                                  "file string")
    got = {r["restored"]: r["source"] for r in fl.restore_names(files).collect()}
    assert got == {"clip_frame_1.png": "clip_frame_1-up.png", "a=1.TXT": "a=1-x.TXT", "plain.jpg": "plain.jpg"}
    only = {r["restored"] for r in fl.restore_names(files, exts=(".png",)).collect()}
    assert only == {"clip_frame_1.png"}


def test_topk_rows_uses_a_partial_limit(spark):
    rows = [(i // 10, "m", i % 10, float((i * 7) % 10)) for i in range(40)]
    df = spark.createDataFrame(rows, "image long, model string, idx int, score double")
    out = sc.topk_rows(df, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = sorted((r["image"], r["rank"], r["idx"]) for r in out.collect() if r["image"] == 0)
    assert got == [(0, 0, 7), (0, 1, 4), (0, 2, 1)]


def test_row_local_rules_have_no_exchange_or_python(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    for key in ["strip_eot", "split_tags", "dedup_order", "basic_clean", "pad_only", "fix_delimiters", "keyword_clean",
                "uploader_year", "post_header_body", "prepend_trigger", "parse_prune_reply",
                "parse_artist_reply", "parse_tag_reply", "topk_scores", "auto_sigmoid", "grid_layout"]:
        plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "MapInPandas" not in plan, key
