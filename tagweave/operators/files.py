"""File-level jobs over an image / caption inventory: extension sets,
content-hash duplicates, caption-image pairing and image completion.

An inventory is a DataFrame with a ``file`` name (``stem + ext``) and, where
needed, the file bytes in ``content`` (the ``binaryFile`` source gives
``path, modificationTime, length, content``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The image extension sets.  The duplicate finder uses the
# first set (with .gif), the model-call and image-completion jobs the second
# (with .tif .tiff); pairing a caption with an image tries only the third,
# in this order, and matches the extension exactly.
DEDUP_IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif")
MODEL_IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
PAIR_IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".webp")


def ext_of(file: Column) -> Column:
    """Suffix of a file name, dot included (``""`` when none), as
    ``Path.suffix`` gives it."""
    return F.regexp_extract(file, r"(\.[^./\\]*)$", 1)


def stem_of(file: Column) -> Column:
    ext = ext_of(file)
    return F.substring(file, F.lit(1), F.length(file) - F.length(ext))


def with_name_parts(df: DataFrame, file: str = "file") -> DataFrame:
    return df.withColumn("stem", stem_of(F.col(file))).withColumn("ext", ext_of(F.col(file)))


def image_files(df: DataFrame, exts=DEDUP_IMAGE_EXTS, file: str = "file") -> DataFrame:
    """Files whose lower-cased suffix is in the extension set."""
    return df.where(F.lower(ext_of(F.col(file))).isin(*exts))


def ext_rank(ext: Column, exts) -> Column:
    """Position of an exact extension in an ordered list (NULL when absent)."""
    expr = None
    for i, e in enumerate(exts):
        expr = F.when(ext == e, i) if expr is None else expr.when(ext == e, i)
    return expr


def content_hash(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("h", F.md5(F.col(content)))


def dedup_groups(images: DataFrame, file: str = "file") -> DataFrame:
    """Per content hash, the file kept (first by name) and the number
    of duplicates.  ``min``/``count`` combine map-side, so a hash holding a
    third of all files costs one partial row per task, not one hot task."""
    h = content_hash(images)
    return h.groupBy("h").agg(F.min(file).alias("keep"), (F.count(F.lit(1)) - 1).cast("bigint").alias("extra"))


def dedup_keep_move(images: DataFrame, file: str = "file") -> DataFrame:
    """Every file with its action: ``keep`` for the first file (by
    name) of its hash, ``move`` for the rest.  Instead of a window over a
    possibly hot hash, the keepers (one row per hash) are joined back on
    ``(h, file)``, a key with no skew."""
    h = content_hash(images).select(F.col(file).alias("file"), "h")
    keepers = h.groupBy("h").agg(F.min("file").alias("file")).withColumn("_keep", F.lit(True))
    j = h.join(keepers, ["h", "file"], "left")
    return j.select("file", "h", F.when(F.col("_keep"), "keep").otherwise("move").alias("action"))


def pair_files(captions: DataFrame, images: DataFrame, name: str = "name", file: str = "file") -> DataFrame:
    """Caption ``<stem>.txt`` with the first existing image of
    ``.png .jpg .jpeg .webp`` (exact extension), inner: captions without an
    image are left out."""
    im = with_name_parts(images.select(F.col(file).alias("file")))
    im = im.withColumn("_r", ext_rank(F.col("ext"), PAIR_IMAGE_EXTS)).where(F.col("_r").isNotNull())
    best = im.groupBy("stem").agg(F.min_by("file", "_r").alias("image"))
    c = captions.select(F.col(name).alias("stem"))
    return c.join(best, "stem", "inner").select(F.concat("stem", F.lit(".txt")).alias("txt"), "image")


def ensure_images(captions: DataFrame, own_images: DataFrame | None, raw_images: DataFrame,
                  name: str = "name", file: str = "file", exts=MODEL_IMAGE_EXTS) -> DataFrame:
    """Every caption stem with the image it ends up with: its own image
    when the folder has one (any extension of the set, exact), else the
    first raw image in extension order, else none.  ``origin`` says which."""
    def best(df, tag):
        d = with_name_parts(df.select(F.col(file).alias("file")))
        d = d.withColumn("_r", ext_rank(F.col("ext"), exts)).where(F.col("_r").isNotNull())
        return d.groupBy("stem").agg(F.min_by("file", "_r").alias(tag))
    c = captions.select(F.col(name).alias("stem"))
    if own_images is None:
        c = c.withColumn("own", F.lit(None).cast("string"))
    else:
        c = c.join(best(own_images, "own"), "stem", "left")
    j = c.join(best(raw_images, "raw"), "stem", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("raw").isNotNull(), "raw")
    return j.select("stem", F.coalesce("own", "raw").alias("image"), origin.alias("origin"))


def restore_names(files: DataFrame, exts=None, file: str = "file") -> DataFrame:
    """T8 as a copy plan: every file (optionally only these lower-cased
    extensions) with its restored name.  Several files can restore to the
    same name; the copy that lands last wins, made explicit here as the
    greatest source name.  Returns ``(restored, source)``, one row per
    restored name."""
    from ..functions.text import restored_stem
    f = files.select(F.col(file).alias("source"))
    if exts is not None:
        f = f.where(F.lower(ext_of(F.col("source"))).isin(*exts))
    f = f.select(F.concat(restored_stem(stem_of(F.col("source"))), ext_of(F.col("source"))).alias("restored"), "source")
    return f.groupBy("restored").agg(F.max("source").alias("source"))
