"""Invariants from the test plan: no job loses a name (except the two that
skip records on purpose), merge output names are the union of the input
names, and the idempotence facts."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tagweave.functions import text as tx
from tagweave.operators import dictionary as dic
from tagweave.sources import fixtures as fx

from .conftest import SF_SMALL


def test_no_job_loses_a_name(spark):
    n_docs = fx.table(spark, SF_SMALL, "documents").count()
    q = E.queries()
    for key in ["strip_eot", "split_tags", "dedup_order", "basic_clean", "pad_only", "prepend_trigger", "sanitize",
                "prune_captions", "save_order", "keep_only_character", "inject_posts", "apply_edits", "caption_prompts"]:
        assert q[key](spark, SF_SMALL).count() == n_docs, key
    # the keyword clean and the uploader/year job skip records on purpose
    assert q["keyword_clean"](spark, SF_SMALL).count() <= n_docs
    n_events = fx.table(spark, SF_SMALL, "events").count()
    assert q["uploader_year"](spark, SF_SMALL).count() < n_events


def test_merge_names_are_the_union(spark):
    merged = {r[0] for r in E.queries()["merge_captions"](spark, SF_SMALL).select("name").collect()}
    names = {r[0] for r in fx.source_captions(spark, SF_SMALL).select("name").distinct().collect()}
    assert merged == names


def test_keep_plus_move_is_every_file(spark):
    km = E.queries()["dedup_keep_move"](spark, SF_SMALL)
    groups = E.queries()["dedup_groups"](spark, SF_SMALL)
    assert km.where("action = 'keep'").count() == groups.count()
    assert km.count() == groups.agg(F.sum(F.col("extra") + 1)).first()[0]


def test_idempotence_facts(spark):
    c = fx.captions(spark, SF_SMALL).select("name", tx.basic_clean("text").alias("t1"))
    c = c.select("t1", tx.basic_clean("t1").alias("t2")).where(~F.col("t1").contains(":"))
    assert c.where(F.col("t1") != F.col("t2")).count() == 0  # basic clean is idempotent without ':'
    d = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("c", 0, 1)], "name string, category int, post_count bigint")
    a = spark.createDataFrame([("a", "b"), ("b", "c")], "antecedent_name string, consequent_name string")
    caps = spark.createDataFrame([("n", "a")], "name string, text string")
    once = dic.sanitize(caps, d, a)
    twice = dic.sanitize(once, d, a)
    assert once.first()["text"] == "b" and twice.first()["text"] == "c"  # one hop: not idempotent
