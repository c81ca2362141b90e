"""Scrape ingest (S9): images with ``.json`` or ``.txt`` sidecars -> raw
captions.

Rules: a JSON sidecar wins over a text one; its ``tags`` (else
``keywords``) -- a list, or a comma-separated string -- become the caption;
a JSON without either gives an empty caption; a JSON that does not parse,
or holds tags that are not strings, gives no caption (and no fallback to
the text sidecar); a text sidecar is copied as is.  JSON is parsed once
into a Variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.files import MODEL_IMAGE_EXTS, ext_of, image_files, stem_of


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _truthy(v: Column) -> Column:
    """Python truthiness of a JSON value held in a Variant."""
    t = _vtype(v)
    s = F.try_variant_get(v, "$", "string")
    return (v.isNotNull() & ~F.is_variant_null(v)
            & F.when(t == "STRING", s != "")
               .when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")).rlike(r"^\s*[\[{]\s*[^\]}\s]"))
               .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
               .otherwise(F.try_variant_get(v, "$", "double") != 0))


def sidecar_caption(json_text: Column) -> Column:
    """``struct(caption, error)`` of one JSON sidecar."""
    v = F.try_parse_json(json_text)
    is_obj = _vtype(v).startswith("OBJECT")
    tags_v = F.try_variant_get(v, "$.tags", "variant")
    kw_v = F.try_variant_get(v, "$.keywords", "variant")
    chosen = F.when(_truthy(tags_v), tags_v).when(_truthy(kw_v), kw_v)
    ct = _vtype(chosen)
    as_list = F.try_variant_get(chosen, "$", "array<string>")
    from_str = tx.comma_pieces(F.try_variant_get(chosen, "$", "string"))
    pieces = F.filter(F.transform(as_list, tx.strip_ws), lambda t: t != "")
    caption = (F.when(chosen.isNull(), F.lit(""))
                .when(ct == "STRING", tx.join_tags(from_str))
                .when(ct.startswith("ARRAY<STRING>") | (ct == "ARRAY<VOID>"), tx.join_tags(pieces)))
    error = (F.when(v.isNull(), F.lit("JSONDecodeError: invalid JSON"))
              .when(~is_obj, F.lit("AttributeError: not a JSON object"))
              .when(caption.isNull(), F.lit("TypeError: tags are not strings")))
    return F.struct(F.when(error.isNull(), caption).alias("caption"), error.alias("error"))


def ingest_scrape(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """S9 over a scrape listing ``files(file, text)`` (``text`` is the file
    content for sidecars, ignored for images).  One row per image:
    ``(stem, image, caption, origin, error)``; ``caption`` NULL means no
    caption file is written."""
    f = files.select(F.col(file).alias("file"), F.col(text).alias("text"))
    im = image_files(f.select("file"), MODEL_IMAGE_EXTS).select(stem_of(F.col("file")).alias("stem"),
                                                              F.col("file").alias("image"))
    side = f.select(stem_of(F.col("file")).alias("stem"), ext_of(F.col("file")).alias("ext"), "text")
    js = side.where(F.col("ext") == ".json").select("stem", F.col("text").alias("json"))
    tt = side.where(F.col("ext") == ".txt").select("stem", F.col("text").alias("txt"))
    j = im.join(js, "stem", "left").join(tt, "stem", "left")
    sc = sidecar_caption(F.col("json"))
    return j.select(
        "stem", "image",
        F.when(F.col("json").isNotNull(), sc["caption"]).otherwise(F.col("txt")).alias("caption"),
        F.when(F.col("json").isNotNull(), F.lit("json")).when(F.col("txt").isNotNull(), F.lit("txt")).alias("origin"),
        F.when(F.col("json").isNotNull(), sc["error"]).alias("error"))
