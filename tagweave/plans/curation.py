"""Composite jobs: artist tags (C3), a multi-model caption or prune stage
with its run summary (C4, A9), and the whole curation run (C5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions import text as tx
from ..functions.replies import parse_artist_reply, parse_tag_reply
from ..operators import files as fl
from ..operators import hooks as hk
from ..operators import merge as mg
from ..session import staged
from ..sources.scrape import ingest_scrape

GENERATE, FILTER = pr.GENERATE, pr.FILTER
EMPTY_REPLY = "empty_reply"  # error code: the model answered nothing


def artist_tags(raw_posts: DataFrame, call: Callable[[list[str]], list[str]], key: str = "event_id",
                raw: str = "raw", instructions: str = pr.ARTIST_DEFAULT_INSTR) -> DataFrame:
    """header/body parse -> prompt -> model -> artist list."""
    hb = raw_posts.select(key, tx.post_header_body(F.col(raw)).alias("p"))
    p = hb.select(key, pr.artist_prompt(F.lit(instructions), F.col("p.uploader"), F.col("p.body")).alias("prompt"))
    r = hk.model_hook(p, call, "prompt", keep=[key])
    return r.select(key, parse_artist_reply(F.col("reply")).alias("text"), "error")


def model_key(model_id: str) -> str:
    """Display name of a model: the last part of its id.  Tables are keyed on
    the full id, so vendors that share it stay apart."""
    return model_id.rsplit("/", 1)[-1]


def parse_model_list(text_col) -> "F.Column":
    """S13 as a column: a JSON list of objects with a non-empty ``model``
    (``prompt`` optional), else a comma / newline separated list of ids;
    ``array<struct<model, prompt>>`` in the given order."""
    elems = F.from_json(text_col, "array<string>")  # objects come back as their JSON text
    objs = F.filter(elems, lambda e: F.regexp_like(e, F.lit(r"^\s*\{")))
    js = F.transform(objs, lambda e: F.from_json(e, "struct<model:string,prompt:string>"))
    from_json = F.filter(js, lambda c: F.coalesce(c["model"], F.lit("")) != "")
    ids = tx.comma_pieces(F.regexp_replace(text_col, "\n", ","))
    from_text = F.transform(ids, lambda m: F.struct(m.alias("model"), F.lit(None).cast("string").alias("prompt")))
    is_list = F.regexp_like(text_col, F.lit(r"^\s*\[")) & elems.isNotNull()
    return F.when(tx.strip_ws(text_col) == "", F.array().cast("array<struct<model:string,prompt:string>>")) \
            .when(is_list, from_json).otherwise(from_text)


def model_stage(items: DataFrame, cfgs: list[dict], mode: str, prompt_fallback: str,
                call_for: Callable[[str], Callable[[list[str]], list[str]]], store: str | None = None) -> DataFrame:
    """C4: every configured model over every image of ``items(image,
    tag_text)``: request (T15) -> model (X2) -> first-line parse (T18).
    One pass: the image x model work list (J12) is expanded row-locally and
    one ``mapInPandas`` sends each row to its model.  Returns ``(cfg, model,
    model_key, image, stem, text, error)``, ``cfg`` the model's place in the
    configuration; a row with an error is a failed record (no caption
    written), the rest go on.  With ``store`` the stage can be stopped and
    rerun: requests that the store answers are not sent again."""
    runs = [(i, c["model"], c.get("prompt", prompt_fallback) or "") for i, c in enumerate(cfgs) if c.get("model")]
    if not runs:
        return None
    cfg = F.array(*[F.struct(F.lit(i).alias("cfg"), F.lit(m).alias("model"), F.lit(p).alias("extra")) for i, m, p in runs])
    work = items.select("image", "tag_text", F.explode(cfg).alias("r")).select(
        "image", "tag_text", "r.cfg", "r.model", "r.extra")
    req = pr.chat_requests(work, mode, F.col("extra"), keep=("cfg", "model"))
    ok, bad = req.where(F.col("error").isNull()), req.where(F.col("error").isNotNull())
    r = hk.model_hook(ok.select("cfg", "model", "image", F.col("request").alias("prompt")), call_for, "prompt",
                      keep=["cfg", "model", "image"], by="model", store=store)
    parsed = r.select("cfg", "model", "image", parse_tag_reply(F.col("reply")).alias("text"), "error")
    parsed = parsed.withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), F.lit(EMPTY_REPLY))))
    allr = parsed.unionByName(bad.select("cfg", "model", "image", F.lit(None).cast("string").alias("text"), "error"))
    return allr.select("cfg", "model", F.regexp_extract("model", r"([^/]*)$", 1).alias("model_key"), "image",
                       fl.stem_of(F.col("image")).alias("stem"),
                       F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def batch_summary(stage: DataFrame, n_failures: int = 20) -> DataFrame:
    """Per model, processed and failed counts and the first failures
    (``"<image>: <error>"``, by image name).  ``stage`` is read twice: pass
    a stage table (``session.staged``), not a plan that still calls models.
    The first-n cut is a window with a row limit, which Spark plans as a
    partial top-n before the shuffle, so a model with many failures still
    sends only n rows."""
    from pyspark.sql import Window
    counts = stage.groupBy("model").agg(F.count_if(F.col("error").isNull()).cast("bigint").alias("processed"),
                                        F.count_if(F.col("error").isNotNull()).cast("bigint").alias("failed"))
    w = Window.partitionBy("model").orderBy("image")
    first = (stage.where(F.col("error").isNotNull()).withColumn("_rn", F.row_number().over(w))
             .where(F.col("_rn") <= n_failures)
             .groupBy("model").agg(F.sort_array(F.collect_list(F.struct("_rn", F.concat("image", F.lit(": "), "error")
                                                                          .alias("line")))).alias("_f")))
    j = counts.join(first, "model", "left")
    return j.select("model", "processed", "failed",
                    F.coalesce(F.array_join(F.transform("_f", lambda x: x["line"]), "\n"), F.lit("")).alias("first_failures"))


def _as_sources(stage: DataFrame) -> DataFrame:
    """Per-model captions as merge sources, in configuration order.  A model
    configured twice is one source, placed where it first appears; inside it
    the later entry that wrote a caption wins."""
    ok = stage.where(F.col("error").isNull()).groupBy("model", "stem").agg(
        F.min("cfg").alias("cfg"), F.max_by("text", "cfg").alias("text"))
    return ok.select(F.col("stem").alias("name"), tx.strip_ws(F.col("text")).alias("text"),
                     F.col("cfg").alias("source_ord"), F.col("model").alias("source"))


@dataclass
class CurationRun:
    """Tables of one whole run: the final captions, and every record that
    gave none, as ``(stage, model, item, error)``."""

    captions: DataFrame
    rejects: DataFrame


def _failed(stage: DataFrame, name: str) -> DataFrame:
    return stage.where(F.col("error").isNotNull()).select(
        F.lit(name).alias("stage"), "model", F.col("image").alias("item"), "error")


def curation_run(spark: SparkSession, scrape_files: DataFrame, caption_cfgs: list[dict], caption_prompt: str,
                 prune_cfgs: list[dict], prune_prompt: str, trigger: str,
                 call_for: Callable[[str], Callable[[list[str]], list[str]]] | None,
                 work_dir: str | None = None) -> CurationRun:
    """Ingest -> (caption models | raw captions) -> merge -> images for
    every caption -> (prune models | pass) -> merge -> trigger.  A model
    stage runs only when models are configured and a caller is given.

    This is a job, not a plan: each model stage is written once as a table
    under ``work_dir`` (default: the shared stage folder) and every reader of
    its captions and failures reads that table, so each record is sent to
    its model once, with or without a checkpoint folder.  What is returned
    is lazy over those tables.

    With a ``work_dir`` the models' answers are kept in its ``replies``
    folder as they come, so a rerun after a failure asks only what is
    missing there."""
    store = f"{work_dir.rstrip('/')}/replies" if work_dir else None
    raw = staged(ingest_scrape(scrape_files), "ingested", work_dir)
    images = raw.select("stem", "image")
    rejects = raw.where(F.col("error").isNotNull()).select(
        F.lit("ingest").alias("stage"), F.lit(None).cast("string").alias("model"), F.col("image").alias("item"), "error")
    if call_for is not None and any(c.get("model") for c in caption_cfgs):
        st = staged(model_stage(images.select("image", F.lit(None).cast("string").alias("tag_text")), caption_cfgs,
                                GENERATE, caption_prompt, call_for, store), "captioned", work_dir)
        sources, rejects = _as_sources(st), rejects.unionByName(_failed(st, "caption"))
    else:
        sources = raw.where(F.col("caption").isNotNull()).select(
            F.col("stem").alias("name"), F.col("caption").alias("text"), F.lit(0).alias("source_ord"))
    merged = mg.merge_captions(sources)
    if call_for is not None and any(c.get("model") for c in prune_cfgs):
        merged = staged(merged, "merged", work_dir)
        with_img = fl.ensure_images(merged, None, images.select(F.col("image").alias("file")))
        items = with_img.where(F.col("image").isNotNull()).join(merged.select(F.col("name").alias("stem"), "text"), "stem")
        items = items.select("image", F.col("text").alias("tag_text"))
        st = staged(model_stage(items, prune_cfgs, FILTER, prune_prompt, call_for, store), "pruned", work_dir)
        rejects = rejects.unionByName(_failed(st, "prune"))
        merged = mg.merge_captions(_as_sources(st))
    return CurationRun(merged.select("name", tx.prepend_trigger(F.col("text"), trigger).alias("text")), rejects)
