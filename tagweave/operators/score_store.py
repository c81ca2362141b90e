"""A stored score table, so that another threshold needs no model.

The ensemble's figures are written once, one row per (image, tag), under bands of the mean score (a partition
column) and, inside a band, in ranges of the tag.  A threshold prunes the bands below it, so their files are
never opened, and is pushed to the scan of the others; a tag is found by the minimum and maximum that each
file keeps of its tags.  The means are kept as (sum, count) and compared exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scores import MICRO, above

BANDS = 20  # bands of the mean score in [0, 1]
SCHEMA = ("image {image}, tag string, sum_micro bigint, n_models bigint, first struct<model_ord:int,rank:int>, "
          "mean_micro bigint, band int")


def write_scores(ensemble: DataFrame, path: str, mode: str = "errorifexists", files_per_band: int | None = None) -> None:
    """``ensemble``: rows of ``scores.ensemble`` (image, tag, sum_micro, n_models, first).  A band's rows are dealt
    by ranges of (band, tag, image), so a band or a tag that holds most of them is spread over many tasks;
    ``files_per_band`` bounds the number of ranges (default: the shuffle partitions over all bands)."""
    mean = F.expr("sum_micro div n_models")  # its floor: the exact test follows at the read
    band = F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor(F.col("mean_micro") * BANDS / MICRO))).cast("int")
    rows = ensemble.select("image", "tag", "sum_micro", "n_models", F.struct(
        F.col("first.model_ord").cast("int").alias("model_ord"), F.col("first.rank").cast("int").alias("rank")).alias("first"),
        mean.alias("mean_micro")).withColumn("band", band)
    order = ("band", "tag", "image")
    dealt = rows.repartitionByRange(*order) if files_per_band is None else \
        rows.repartitionByRange(files_per_band * BANDS, *order)
    dealt.sortWithinPartitions(*order).write.mode(mode).partitionBy("band").parquet(path)


def read_scores(spark: SparkSession, path: str, threshold: float | None = None, tags: list[str] | None = None,
                image: str = "bigint") -> DataFrame:
    """The stored rows, those whose mean is strictly above ``threshold`` (P5), of ``tags`` only where given.
    ``image`` is the type of the image ids."""
    d = spark.read.schema(SCHEMA.format(image=image)).parquet(path)
    if threshold is not None:
        micro = int(round(threshold * MICRO))
        # bands and means that can't pass are pruned; the floor of the mean is never below a threshold it passes
        d = d.where(F.col("band") >= max(0, min(BANDS - 1, micro * BANDS // MICRO))).where(F.col("mean_micro") >= micro) \
            .where(above(F.col("sum_micro"), F.col("n_models"), threshold))
    if tags is not None:
        d = d.where(F.col("tag").isin(*tags))
    return d.select("image", "tag", "sum_micro", "n_models", "first")
