"""Review, edits and the final data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .files import MODEL_IMAGE_EXTS, image_files, stem_of


def review_items(images: DataFrame, model_captions: DataFrame | None, merged: DataFrame | None = None,
                 file: str = "file") -> DataFrame:
    """J11 + A4 + A5: one row per image of the raw folder with the sorted
    union of its tags over all models and the tags by model.

    ``model_captions(model, name, text)`` are the per-model outputs; where
    they hold no row at all, the merged captions are used for the union and
    the by-model map stays empty.  Caption text is split on ``,``, stripped,
    empties dropped.  Two captions of one (model, name) leave the one of
    smallest text.  Captions are gathered by stem first (bounded by the
    number of models), then joined to the images.
    """
    im = image_files(images.select(F.col(file).alias("file")), MODEL_IMAGE_EXTS)
    im = im.withColumn("stem", stem_of(F.col("file")))
    none = F.lit(None).cast("string")
    if model_captions is None:
        src = merged.select(none.alias("model"), "name", "text")
    else:
        src = model_captions.select("model", "name", "text")
        if merged is not None:
            src = src.unionByName(merged.where(~model_captions.exists()).select(none.alias("model"), "name", "text"))
    caps = src.groupBy(F.col("name").alias("stem"), "model").agg(F.min("text").alias("text")) \
        .select("stem", "model", tx.comma_pieces(F.col("text")).alias("tags"))
    item = F.when(F.col("model").isNotNull(), F.struct("model", "tags"))
    g = caps.groupBy("stem").agg(F.collect_list("tags").alias("_all"), F.collect_list(item).alias("_bm"))
    g = g.select("stem", F.sort_array(F.array_distinct(F.flatten("_all"))).alias("union"),
                 F.map_from_entries(F.sort_array("_bm")).alias("by_model"))
    empty = F.array().cast("array<string>")
    return im.join(g, "stem", "left").select(
        F.col("file").alias("image"), F.coalesce("union", empty).alias("union"),
        F.coalesce("by_model", F.create_map().cast("map<string,array<string>>")).alias("by_model"))


def apply_edits(stored: DataFrame, edits: DataFrame, name: str = "name") -> DataFrame:
    """Edited captions replace the stored ones (new names are added)."""
    keep = stored.join(edits.select(name), name, "left_anti")
    return keep.unionByName(edits.select(*stored.columns))


def finalize(review: DataFrame, images: DataFrame, trigger: str, name: str = "name", text: str = "text",
             file: str = "file") -> DataFrame:
    """The final set, one row per stem: the review caption with the
    trigger in front, and the raw images of the stem (sorted).  Full outer:
    captions and images are copied whole, a caption once however many
    images share its stem."""
    c = review.select(F.col(name).alias("stem"), tx.prepend_trigger(F.col(text), trigger).alias("text"))
    im = image_files(images.select(F.col(file).alias("file")), MODEL_IMAGE_EXTS)
    im = im.groupBy(stem_of(F.col("file")).alias("stem")).agg(F.sort_array(F.collect_list("file")).alias("images"))
    return c.join(im, "stem", "full_outer").select(
        "stem", "text", F.coalesce("images", F.array().cast("array<string>")).alias("images"))


def finalize_summary(final: DataFrame) -> DataFrame:
    """K5: how many captions and images the final set holds (one row)."""
    return final.agg(F.count("text").cast("bigint").alias("captions"),
                     F.coalesce(F.sum(F.size("images")), F.lit(0)).cast("bigint").alias("images"))


def work_list(images: DataFrame, models: list[str], file: str = "file") -> DataFrame:
    """Image x model work list, expanded row-locally (the model list
    is a job parameter)."""
    return images.select(F.col(file).alias("image"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
