"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, derives its input from the parquet
tables with Spark (``sources.fixtures``) and returns a DataFrame whose
column names match the oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dictionary as dic
from ..operators.lookup import lookup
from ..sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn
    return deco


def _caps(spark, sf):
    return fx.captions(spark, sf)


def _tagrows(df: DataFrame, arr, name="name") -> DataFrame:
    """Array -> ``(n_tags, tags)`` with the pieces joined by `` | `` (a
    scalar form both engines hash the same way)."""
    return df.select(name, F.size(arr).cast("bigint").alias("n_tags"), F.array_join(arr, " | ").alias("tags"))


# ---------------------------------------------------------------- text jobs

@query("strip_eot")
def q_strip_eot(spark, sf):
    return _caps(spark, sf).select("name", tx.strip_eot("text").alias("text"))


@query("split_tags")
def q_split_tags(spark, sf):
    return _tagrows(_caps(spark, sf), tx.split_tags("text"))


@query("dedup_order")
def q_dedup_order(spark, sf):
    return _tagrows(_caps(spark, sf), tx.dedup_order(tx.split_caption("text")))


@query("basic_clean")
def q_basic_clean(spark, sf):
    return _caps(spark, sf).select("name", tx.basic_clean("text").alias("text"))


def _raw_caps(spark, sf):
    """Free prose as caption files: pieces between ``", "`` hold blanks,
    line breaks and punctuation."""
    d = fx.table(spark, sf, "documents")
    return d.select(fx.image_name(F.col("doc_id")).alias("name"), "text")


@query("pad_only")
def q_pad_only(spark, sf):
    return _raw_caps(spark, sf).select("name", tx.pad_only("text").alias("text"))


@query("fix_delimiters")
def q_fix_delimiters(spark, sf):
    c = fx.replies(spark, sf).select(F.concat_ws("_", "conv_id", "turn").alias("name"), F.col("reply").alias("text"))
    return c.select("name", tx.normalize_delimiters("text").alias("text"),
                    (tx.normalize_delimiters("text") != F.col("text")).alias("changed"))


@query("fix_delimiters_summary")
def q_fix_delimiters_summary(spark, sf):
    c = fx.replies(spark, sf).select(F.col("reply").alias("text"))
    ch = tx.normalize_delimiters("text") != F.col("text")
    return c.agg(F.count_if(ch).cast("bigint").alias("changed"), F.count_if(~ch).cast("bigint").alias("unchanged"))


@query("keyword_clean")
def q_keyword_clean(spark, sf):
    c = _raw_caps(spark, sf).select("name", tx.pad_only("text").alias("text"))
    return c.where(~tx.is_blank("text")).select("name", tx.keyword_clean("text", "solo").alias("text"))


@query("keyword_clean_summary")
def q_keyword_clean_summary(spark, sf):
    """P9 for T7: captions written and blank ones skipped (every seventh
    document stands for an empty caption file)."""
    c = _raw_caps(spark, sf).select(F.when(F.substring("name", -1, 1) == "7", F.lit(" \n")).otherwise(tx.pad_only("text")).alias("text"))
    blank = tx.is_blank("text")
    return c.agg(F.count_if(~blank).cast("bigint").alias("written"), F.count_if(blank).cast("bigint").alias("skipped"))


@query("restore_names")
def q_restore_names(spark, sf):
    from ..operators import files as fl
    return fl.restore_names(fx.file_names(spark, sf).select(F.concat("stem", "ext").alias("file")))


@query("inject_artist_year")
def q_inject_artist_year(spark, sf):
    c = _caps(spark, sf)
    p = fx.posts(spark, sf).where("artist <> ''")
    j = p.join(c, p.filename == c.name, "inner")
    return j.select("post_id", "name", tx.inject_artist_year("text", "artist", "year").alias("text"))


@query("uploader_year")
def q_uploader_year(spark, sf):
    r = fx.raw_posts(spark, sf).select("event_id", tx.uploader_year("raw").alias("text"))
    return r.where(F.col("text").isNotNull())


@query("uploader_year_summary")
def q_uploader_year_summary(spark, sf):
    """P9 for T10: posts that gave a caption and posts skipped."""
    made = tx.uploader_year("raw").isNotNull()
    return fx.raw_posts(spark, sf).agg(F.count_if(made).cast("bigint").alias("written"),
                                       F.count_if(~made).cast("bigint").alias("skipped"))


@query("post_header_body")
def q_post_header_body(spark, sf):
    r = fx.raw_posts(spark, sf).select("event_id", tx.post_header_body("raw").alias("p"))
    return r.select("event_id", "p.uploader", "p.body")


@query("prepend_trigger")
def q_prepend_trigger(spark, sf):
    c = _caps(spark, sf).select("name", tx.basic_clean("text").alias("text"))
    return c.select("name", tx.prepend_trigger("text", "abo").alias("text"))


# ---------------------------------------------------------- caption files
from ..sources import files as rd  # noqa: E402


@query("src_captions")
def q_src_captions(spark, sf):
    return rd.decode_captions(fx.caption_bytes(spark, sf)).select("file", "name", "text")


@query("src_captions_recursive")
def q_src_captions_recursive(spark, sf):
    return rd.decode_captions(fx.caption_bytes(spark, sf), lenient=True).select("file", "name", "text")


@query("src_multi")
def q_src_multi(spark, sf):
    """S3: caption sources in order, the first one named twice."""
    s = fx.source_captions(spark, sf).select("source", F.concat("name", F.lit(".txt")).alias("file"), "name", "text")
    named = [(n, s.where(F.col("source") == n)) for n in ("tagger2", "tagger1", "tagger2", "tagger3")]
    return rd.stack_sources(named).select("source", "source_ord", "file", "name", "text")


# ---------------------------------------------------------- dictionary jobs

@query("live_tags")
def q_live_tags(spark, sf):
    return dic.live_tags(fx.dictionary(spark, sf)).select("name", "category", "post_count")


PIECE_BYTES = 8 << 20  # of captions in a task that explodes and regroups their tags


def _dealt_by_name(spark, sf, c: DataFrame) -> DataFrame:
    """Captions dealt by name before their tags become rows, in pieces by the measured size of the texts: the regroup
    by name then stays in the task, and its rows in memory (as whole texts they are a tenth of that)."""
    size = fx.table(spark, sf, "documents").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return c.repartition(max(spark.sparkContext.defaultParallelism, size // PIECE_BYTES), "name")


def _caption_tag_rows(spark, sf):
    c = _dealt_by_name(spark, sf, fx.plain_captions(spark, sf).select("name", "text"))
    return c.select("name", F.posexplode(tx.split_caption("text")).alias("pos", "tag"))


def _joined(t: DataFrame, value: str = "tag") -> DataFrame:
    """Rows ``(name, pos, value)`` back as one text per name, in order."""
    g = t.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("s"))
    return g.select("name", F.array_join(F.col(f"s.{value}"), " | ").alias("tags"))


@query("known_tags")
def q_known_tags(spark, sf):
    return _joined(dic.known_tags(_caption_tag_rows(spark, sf), fx.dictionary(spark, sf)))


@query("drop_year_tags")
def q_drop_year_tags(spark, sf):
    return _joined(dic.drop_year_tags(_caption_tag_rows(spark, sf)))


@query("drop_categories")
def q_drop_categories(spark, sf):
    live = dic.live_tags(fx.dictionary(spark, sf)).select(F.col("name").alias("_name"), "category")
    t = lookup(_caption_tag_rows(spark, sf), live, F.col("tag"), "_name", stored=True)
    return _joined(dic.drop_categories(t))


@query("alias_map")
def q_alias_map(spark, sf):
    return dic.alias_map(fx.alias_rows(spark, sf))


@query("canonical_tags")
def q_canonical_tags(spark, sf):
    t = _caption_tag_rows(spark, sf)
    return _joined(dic.canonicalize(t, dic.alias_map(fx.alias_rows(spark, sf))), "canon")


@query("tag_category")
def q_tag_category(spark, sf):
    c = fx.captions(spark, sf)
    t = c.select("name", F.posexplode(tx.split_caption("text")).alias("pos", "tag"))
    return _joined(dic.with_category_code(t, fx.dictionary(spark, sf)), "code")


@query("sanitize")
def q_sanitize(spark, sf):
    return dic.sanitize(fx.plain_captions(spark, sf), fx.dictionary(spark, sf),
                        dic.alias_map(fx.alias_rows(spark, sf)))


# ------------------------------------------------------------- merge family
from ..operators import merge as mg  # noqa: E402
from ..operators import posts as po  # noqa: E402

TRIGGER = "der"


@query("merge_captions")
def q_merge_captions(spark, sf):
    return mg.merge_captions(fx.source_captions(spark, sf))


@query("all_names")
def q_all_names(spark, sf):
    return mg.all_names(fx.source_captions(spark, sf))


@query("merge_priority")
def q_merge_priority(spark, sf):
    s = fx.source_captions(spark, sf).where(F.col("source_ord") <= 2)
    return mg.merge_priority(s, fx.dictionary(spark, sf))


@query("save_order")
def q_save_order(spark, sf):
    c = fx.captions(spark, sf)
    t = c.select("name", F.posexplode_outer(F.array_distinct(tx.comma_pieces("text"))).alias("pos", "tag"))
    return mg.save_order(dic.with_category_code(t, fx.dictionary(spark, sf), stripped=True))


@query("keep_only_character")
def q_keep_only_character(spark, sf):
    return mg.keep_only_character(fx.captions(spark, sf), fx.dictionary(spark, sf), TRIGGER)


# -------------------------------------------------------------------- posts

@query("inject_posts")
def q_inject_posts(spark, sf):
    return po.inject_posts(fx.posts(spark, sf), fx.captions(spark, sf))


@query("inject_posts_summary")
def q_inject_posts_summary(spark, sf):
    return po.inject_posts_summary(fx.posts(spark, sf), fx.captions(spark, sf))


@query("src_post_meta")
def q_src_post_meta(spark, sf):
    return po.parse_post_meta(fx.post_meta(spark, sf)).select("post_no", "post_key", "artist", "year", "filename")


@query("inject_post_meta")
def q_inject_post_meta(spark, sf):
    """S8 into J5: posts read from their JSON files, applied in file and
    object order."""
    p = po.parse_post_meta(fx.post_meta(spark, sf), keep=("file",))
    return po.inject_posts(p, fx.captions(spark, sf), order=("file", "post_no"))


# ------------------------------------------------------------------- scores
from ..operators import heat as ht  # noqa: E402
from ..operators import score_store as ss  # noqa: E402
from ..operators import scores as sc  # noqa: E402
from ..session import stage_root  # noqa: E402
from . import stubs  # noqa: E402

# Query parameters: the operators default to the reference's k = 250 and
# threshold 0.2; the fixture models have 40 labels and scores in
# [0.24, 0.73], so the top-k query cuts at 25 and the thresholds sit at 0.5.
K_CUT = 25
THR = 0.5
THR_RETHRESHOLD = 0.55


def _slices(spark, sf):
    s = sc.model_slices(fx.table(spark, sf, "embeddings"), fx.SCORE_MODELS)
    return s.select("image", "model", "model_ord", sc.micro_scores(F.col("raw")).alias("scores"))


@query("topk_scores")
def q_topk_scores(spark, sf):
    t = _slices(spark, sf).select("image", "model", F.posexplode(sc.topk(F.col("scores"), K_CUT)).alias("rank", "x"))
    return t.select("image", "model", F.col("rank").cast("bigint").alias("rank"),
                    F.col("x.idx").cast("bigint").alias("idx"), F.col("x.score").alias("score"))


@query("score_labels")
def q_score_labels(spark, sf):
    r = _slices(spark, sf).select("image", "model", sc.topk(F.col("scores")).alias("top"))
    r = sc.attach_labels(r, fx.vocabulary(spark, sf))
    e = r.select("image", "model", F.explode(sc.dedup_labels("top")).alias("x"))
    return e.select("image", "model", "x.tag", "x.score", F.col("x.rank").cast("bigint").alias("rank"))


@query("batch_tag")
def q_batch_tag(spark, sf):
    return sc.batch_tag(_slices(spark, sf), fx.vocabulary(spark, sf), THR)


@query("tag_string")
def q_tag_string(spark, sf):
    return sc.batch_tag(_slices(spark, sf), fx.vocabulary(spark, sf), 0.0)


def _ensemble(spark, sf):
    return sc.ensemble(_slices(spark, sf), fx.vocabulary(spark, sf))


@query("ensemble_scores")
def q_ensemble_scores(spark, sf):
    e = _ensemble(spark, sf)
    return e.where(sc.above(F.col("sum_micro"), F.col("n_models"), THR)).select("image", "tag", "sum_micro", "n_models")


@query("ensemble_tag_string")
def q_ensemble_tag_string(spark, sf):
    return sc.ensemble_tag_string(_ensemble(spark, sf), THR)


_SCORES: dict[tuple[str, str], str] = {}


def _stored_scores(spark, sf) -> str:
    """The ensemble's score table, written once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SCORES:
        path = f"{stage_root(spark)}/scores-{uuid.uuid4().hex}"
        ss.write_scores(_ensemble(spark, sf), path)
        _SCORES[key] = path
    return _SCORES[key]


@query("score_threshold")
def q_score_threshold(spark, sf):
    """Another threshold over the stored scores; no model is scored again."""
    d = ss.read_scores(spark, _stored_scores(spark, sf), THR_RETHRESHOLD)
    return d.select("image", "tag", "sum_micro", "n_models")


@query("rethreshold_tag_string")
def q_rethreshold_tag_string(spark, sf):
    """C9 + G3: the tag strings at another threshold, from the stored scores; images that keep no tag have no row."""
    return sc.ensemble_tag_string(ss.read_scores(spark, _stored_scores(spark, sf), THR_RETHRESHOLD), THR_RETHRESHOLD)


@query("label_index")
def q_label_index(spark, sf):
    e = _ensemble(spark, sf).where(sc.above(F.col("sum_micro"), F.col("n_models"), THR))
    models = F.array(*[F.lit(m) for m, _, _ in fx.SCORE_MODELS])
    req = e.select("image", "tag", F.explode(models).alias("model"))
    return sc.label_index(fx.vocabulary(spark, sf), req).select(
        "image", "model", "tag", F.col("idx").cast("bigint").alias("idx"))


@query("labels_padded")
def q_labels_padded(spark, sf):
    nc = fx.small_table(spark, [("m1", 43), ("m2", 40)], ["model", "num_classes"])
    return sc.pad_labels(fx.vocabulary(spark, sf), nc)


def _head_scores(spark, sf, head, n_labels):
    e = fx.table(spark, sf, "embeddings")
    s = sc.dense_scores(e, fx.head_weights(spark, n_labels), head=head)
    x = s.select("image", F.posexplode("scores").alias("l", "s"))
    return x.select(F.col("image").alias("vec_id"), F.col("l").cast("bigint").alias("l"),
                    F.floor(F.col("s") * sc.MICRO).cast("bigint").alias("micro"))


@query("linear_scores")
def q_linear_scores(spark, sf):
    return _head_scores(spark, sf, "linear", 20)


@query("gated_scores")
def q_gated_scores(spark, sf):
    return _head_scores(spark, sf, "gated", 20)


@query("auto_sigmoid")
def q_auto_sigmoid(spark, sf):
    s = sc.model_slices(fx.table(spark, sf, "embeddings"), fx.SCORE_MODELS)
    prob = F.transform("raw", lambda v: (v.cast("double") + 1) / 2)
    both = s.select("image", "model", F.explode(F.array(
        F.struct(F.lit("logit").alias("kind"), sc.auto_sigmoid(F.col("raw")).alias("p")),
        F.struct(F.lit("prob").alias("kind"), sc.auto_sigmoid(prob).alias("p")))).alias("x"))
    x = both.select("image", "model", "x.kind", F.posexplode("x.p").alias("idx", "p"))
    return x.select("image", "model", "kind", F.col("idx").cast("bigint").alias("idx"),
                    F.floor(F.col("p") * sc.MICRO).cast("bigint").alias("micro"))


# --------------------------------------------------------------------- heat

@query("grid_layout")
def q_grid_layout(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", F.length("html").alias("n"))
    g = p.select("page_id", F.col("n").cast("bigint").alias("n"), ht.grid_layout(F.col("n")).alias("g"))
    return g.select("page_id", "n", F.col("g.h").cast("bigint").alias("h"), F.col("g.w").cast("bigint").alias("w"))


@query("heat_fuse")
def q_heat_fuse(spark, sf):
    return ht.heat_fuse(fx.heat_cells(spark, sf))


@query("heat_mask")
def q_heat_mask(spark, sf):
    f = ht.heat_fuse(fx.heat_cells(spark, sf))
    return f.select("image", "tag", "cell", ht.heat_mask(F.col("num"), F.col("den"), 0.35, 0.6).alias("mask"))


@query("patch_saliency")
def q_patch_saliency(spark, sf):
    a, g = fx.patch_values(spark, sf)
    return ht.patch_saliency(a, g)


# -------------------------------------------------------------- files, review
from ..operators import digests as dg  # noqa: E402
from ..operators import files as fl  # noqa: E402
from ..operators import review as rv  # noqa: E402
from ..sources import caption_folder as cf  # noqa: E402

STAGE_MODELS = ["vendor/alpha", "lab/beta"]


def _own_images(spark, sf):
    """Images already in a caption folder: a ``.bmp`` copy for German
    documents."""
    d = fx.table(spark, sf, "documents").where(F.col("lang") == "de")
    return d.select(F.concat(fx.image_name(F.col("doc_id")), F.lit(".bmp")).alias("file"))


@query("src_images")
def q_src_images(spark, sf):
    im = fl.image_files(fx.image_files(spark, sf))
    return im.select("file", F.length("content").cast("bigint").alias("n_bytes"))


@query("dedup_groups")
def q_dedup_groups(spark, sf):
    return fl.dedup_groups(fl.image_files(fx.image_files(spark, sf)))


@query("dedup_keep_move")
def q_dedup_keep_move(spark, sf):
    return fl.dedup_keep_move(fl.image_files(fx.image_files(spark, sf)))


@query("pair_files")
def q_pair_files(spark, sf):
    return fl.pair_files(fx.captions(spark, sf), fx.image_files(spark, sf))


def _caption_folder(spark, sf) -> str:
    """K1/K3: the captions as one text file each, by the data source."""
    spark.dataSource.register(cf.CaptionFolder)
    folder = f"{stage_root(spark)}/captions-{uuid.uuid4().hex}"
    fx.captions(spark, sf).select("name", "text").write.format("caption_folder").mode("append").save(folder)
    return folder


@query("sink_captions")
def q_sink_captions(spark, sf):
    """K1, read back through the data source."""
    return spark.read.format("caption_folder").load(_caption_folder(spark, sf)).select("file", "name", "text")


@query("dedup_files")
def q_dedup_files(spark, sf):
    """A6/W3 over real files: digests read in pieces, of lengths that occur twice."""
    return dg.keep_move(dg.file_digests(dg.file_inventory(spark, _caption_folder(spark, sf), (".txt",))))


@query("ensure_images")
def q_ensure_images(spark, sf):
    return fl.ensure_images(fx.captions(spark, sf), _own_images(spark, sf), fx.image_files(spark, sf))


def _model_captions(spark, sf):
    s = fx.source_captions(spark, sf)
    return s.select(F.col("source").alias("model"), "name", "text")


@query("review_union")
def q_review_union(spark, sf):
    r = rv.review_items(fx.image_files(spark, sf), _model_captions(spark, sf))
    return _tagrows(r, F.col("union"), "image")


@query("review_by_model")
def q_review_by_model(spark, sf):
    r = rv.review_items(fx.image_files(spark, sf), _model_captions(spark, sf))
    e = r.select("image", F.explode("by_model").alias("model", "tags"))
    return e.select("image", "model", F.array_join("tags", " | ").alias("tags"))


@query("review_items")
def q_review_items(spark, sf):
    """Review set when the models wrote nothing: the job falls back to the
    merged captions."""
    src = fx.source_captions(spark, sf)
    r = rv.review_items(fx.image_files(spark, sf), _model_captions(spark, sf).where("model = 'tagger9'"), mg.merge_captions(src))
    return r.select("image", F.size("union").cast("bigint").alias("n_tags"), F.array_join("union", " | ").alias("tags"),
                    F.size("by_model").cast("bigint").alias("n_models"))


@query("apply_edits")
def q_apply_edits(spark, sf):
    stored = fx.captions(spark, sf).select("name", "text")
    d = fx.table(spark, sf, "documents").where(F.col("lang") == "fr")
    edits = d.select(fx.image_name(F.col("doc_id")).alias("name"), F.concat(F.lit("edited, "), "source").alias("text"))
    return rv.apply_edits(stored, edits)


@query("finalize")
def q_finalize(spark, sf):
    return _final(spark, sf).select("stem", "text", F.array_join("images", " | ").alias("images"))


def _final(spark, sf):
    """Captions of every document; two image files for every third stem."""
    im = fx.image_files(spark, sf).select("doc_id", "file")
    twin = im.where("doc_id % 3 = 0").select("doc_id", F.concat(fx.image_name(F.col("doc_id")), F.lit(".jpeg")).alias("file"))
    return rv.finalize(mg.merge_captions(fx.source_captions(spark, sf)), im.unionByName(twin), "abo")


@query("finalize_summary")
def q_finalize_summary(spark, sf):
    return rv.finalize_summary(_final(spark, sf))


@query("work_list")
def q_work_list(spark, sf):
    im = fl.image_files(fx.image_files(spark, sf), fl.MODEL_IMAGE_EXTS)
    return rv.work_list(im, STAGE_MODELS)


# ------------------------------------------------- prompts, replies, stages
from ..functions import prompts as pr  # noqa: E402
from ..functions import replies as rp  # noqa: E402
from ..operators import hooks as hk  # noqa: E402
from ..operators import prune as pn  # noqa: E402
from ..sources.scrape import ingest_scrape  # noqa: E402
from . import curation as cu  # noqa: E402
from ..session import staged  # noqa: E402

CAPTION_TYPES = list(pr.CAPTION_TYPE_MAP)
PRUNE_MODELS = [{"model": "team/gamma"}, {"model": "lab/delta"}]
CAPTION_MODELS = [{"model": m} for m in STAGE_MODELS]


@query("caption_prompts")
def q_caption_prompts(spark, sf):
    d = fx.table(spark, sf, "documents")
    ctype = F.element_at(F.array(*[F.lit(t) for t in CAPTION_TYPES]), (F.col("doc_id") % len(CAPTION_TYPES) + 1).cast("int"))
    length = (F.when(F.col("doc_id") % 3 == 0, F.lit("any"))
               .when(F.col("doc_id") % 3 == 1, F.size(fx.words(F.col("text"))).cast("string"))
               .when(F.col("n_chars") > 5000, F.lit("very long")).otherwise(F.lit("short")))
    extras = F.when(F.col("lang") == "en", F.array(F.lit(pr.NAME_OPTION))).otherwise(F.array().cast("array<string>"))
    name = F.when(F.col("source").isin("src1", "src2"), F.lit("")).otherwise(F.concat(F.lit("Char_"), "source"))
    req = d.select(fx.image_name(F.col("doc_id")).alias("key"), ctype.alias("caption_type"),
                   length.alias("caption_length"), extras.alias("extras"), name.alias("name"))
    return pr.caption_prompts(req, pr.caption_templates(spark)).withColumnRenamed("key", "name")


ARTIST_TEMPLATE = "Artists behind the post of <UPLOADER> (<POSTER>):\n<BODY>"


@query("artist_prompts")
def q_artist_prompts(spark, sf):
    hb = fx.raw_posts(spark, sf).select("event_id", "event_type", tx.post_header_body("raw").alias("p"))
    instr = F.when(F.col("event_type") == "click", F.lit(ARTIST_TEMPLATE)).otherwise(F.lit(pr.ARTIST_DEFAULT_INSTR))
    return hb.select("event_id", pr.artist_prompt(instr, F.col("p.uploader"), F.col("p.body")).alias("prompt"))


def _filter_items(spark, sf):
    im = fl.image_files(fx.image_files(spark, sf), fl.MODEL_IMAGE_EXTS).select(
        "file", fl.stem_of(F.col("file")).alias("stem"))
    d = fx.table(spark, sf, "documents").where(F.col("lang") != "es")
    caps = fx.captions(spark, sf).join(d.select("doc_id"), "doc_id", "left_semi").select(
        F.col("name").alias("stem"), F.col("text").alias("tag_text"))
    return im.join(caps, "stem", "left").select(F.col("file").alias("image"), "tag_text")


@query("chat_requests")
def q_chat_requests(spark, sf):
    r = pr.chat_requests(_filter_items(spark, sf), cu.FILTER, "Keep it short.")
    return r.select("image", "user_text", "request", "error")


@query("parse_prune_reply")
def q_parse_prune_reply(spark, sf):
    r = fx.replies(spark, sf)
    t = r.select("conv_id", "turn", rp.parse_prune_reply(F.col("reply")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").cast("bigint").alias("n_tags"), F.array_join("t", " | ").alias("tags"))


@query("parse_artist_reply")
def q_parse_artist_reply(spark, sf):
    return fx.artist_replies(spark, sf).select("conv_id", "turn", rp.parse_artist_reply(F.col("reply")).alias("text"))


@query("parse_tag_reply")
def q_parse_tag_reply(spark, sf):
    return fx.replies(spark, sf).select("conv_id", "turn", rp.parse_tag_reply(F.col("reply")).alias("text"))


def _proposals(spark, sf):
    """Prune replies paired with the caption of the same turn."""
    r = fx.replies(spark, sf).select("conv_id", "turn", rp.parse_prune_reply(F.col("reply")).alias("proposed"))
    c = fx.turn_captions(spark, sf).select("conv_id", "turn", pn.caption_pieces(F.col("text")).alias("tags"))
    c = c.withColumn("tags_lower", F.transform("tags", F.lower))
    return r.join(c, ["conv_id", "turn"], "inner")


@query("guard_proposals")
def q_guard_proposals(spark, sf):
    g = pn.guard(_proposals(spark, sf), "proposed", "tags_lower", "k")
    return g.select("conv_id", "turn", F.size("k").cast("bigint").alias("n_kept"), F.array_join("k", " | ").alias("kept"))


@query("prune_tags")
def q_prune_tags(spark, sf):
    p = pn.guard(_proposals(spark, sf), "proposed", "tags_lower", "removed")
    return p.select("conv_id", "turn", tx.join_tags(pn.remove_tags(F.col("tags"), F.col("removed"))).alias("text"))


def _prune_replies(spark, sf, keep=("name",)):
    c = fx.captions(spark, sf)
    prompts = c.select("name", "text", pr.prune_prompt(F.col("text")).alias("prompt"))
    return hk.model_hook(prompts, stubs.prune_stub, "prompt", keep=list(keep))


@query("model_hook")
def q_model_hook(spark, sf):
    return _prune_replies(spark, sf).select("name", "reply", "error")


@query("prune_captions")
def q_prune_captions(spark, sf):
    r = _prune_replies(spark, sf, keep=("name", "text"))
    return pn.prune_captions(r, fx.dictionary(spark, sf))


@query("artist_tags")
def q_artist_tags(spark, sf):
    return cu.artist_tags(fx.raw_posts(spark, sf), stubs.artist_stub).select("event_id", "text")


@query("apply_transform")
def q_apply_transform(spark, sf):
    """One caller function of either kind: on columns, then a Python one."""
    c = hk.apply_transform(fx.captions(spark, sf).select("name", "text"), lambda t: F.replace(t, F.lit("e"), F.lit("E")))
    return hk.apply_python_transform(c, lambda t: t.replace("a", "A"))


@query("ingest_scrape")
def q_ingest_scrape(spark, sf):
    return ingest_scrape(fx.scrape_files(spark, sf)).select("stem", "image", "caption", "origin")


@query("quarantine")
def q_quarantine(spark, sf):
    _, bad = hk.split_quarantine(ingest_scrape(fx.scrape_files(spark, sf)))
    return bad.select("stem", "error")


def _stage(spark, sf, call_for=stubs.chat_stub, store=None):
    im = fl.image_files(fx.image_files(spark, sf), fl.MODEL_IMAGE_EXTS)
    items = im.select(F.col("file").alias("image"), F.lit(None).cast("string").alias("tag_text"))
    return cu.model_stage(items, CAPTION_MODELS, cu.GENERATE, "", call_for, store)


@query("multi_model_stage")
def q_multi_model_stage(spark, sf):
    return _stage(spark, sf).select("model", "model_key", "image", "stem", "text", "error")


@query("multi_model_resumed")
def q_multi_model_resumed(spark, sf):
    """C4 over a reply store, run a second time: every answer comes from the store."""
    store = f"{stage_root(spark)}/replies-{uuid.uuid4().hex}"
    _stage(spark, sf, stubs.chat_stub, store).select("text").write.format("noop").mode("overwrite").save()
    return _stage(spark, sf, stubs.no_calls, store).select("model", "model_key", "image", "stem", "text", "error")


@query("batch_summary")
def q_batch_summary(spark, sf):
    return cu.batch_summary(staged(_stage(spark, sf), "batch-summary"))


@query("curation_run")
def q_curation_run(spark, sf):
    """C5 with caption models and prune models."""
    return cu.curation_run(spark, fx.scrape_files(spark, sf), CAPTION_MODELS, "", PRUNE_MODELS, "", "abo",
                           stubs.chat_stub).captions


def _raw_run(spark, sf):
    return cu.curation_run(spark, fx.scrape_files(spark, sf), [], "", PRUNE_MODELS, "", "abo", stubs.chat_stub)


@query("curation_run_raw")
def q_curation_run_raw(spark, sf):
    """C5 on the scraped captions, prune models only."""
    return _raw_run(spark, sf).captions


@query("curation_rejects")
def q_curation_rejects(spark, sf):
    """Every record of that run that gave no caption, and why."""
    return _raw_run(spark, sf).rejects


@query("model_configs")
def q_model_configs(spark, sf):
    """S13 over model-list texts written per event: a JSON list (with an
    entry without a model, which is dropped), a comma / newline list, or
    nothing."""
    e = fx.table(spark, sf, "events")
    m = F.col("event_id") % 3
    text = (F.when(m == 0, F.concat(F.lit('[{"model": "vendor/'), F.col("event_type"), F.lit('", "prompt": "p'),
                                    F.col("user_id").cast("string"), F.lit('"}, {"model": ""}, {"model": "lab/'),
                                    F.col("user_id").cast("string"), F.lit('"}]')))
             .when(m == 1, F.concat(F.lit("vendor/"), F.col("event_type"), F.lit(", lab/u"),
                                    F.col("user_id").cast("string"), F.lit("\n team/z ,")))
             .otherwise(F.lit("  ")))
    cfg = e.select("event_id", F.posexplode(cu.parse_model_list(text)).alias("model_ord", "c"))
    return cfg.select("event_id", F.col("model_ord").cast("bigint").alias("model_ord"), "c.model", "c.prompt")
