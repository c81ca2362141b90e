"""Records of a delimited export, in file order, read in parallel.

A quoted field may hold line breaks, so a line is not a record, and a split of the file may begin inside a quoted
field.  Each split counts its quotes and how many records start in it, both if it begins outside quotes and if it
begins inside; sums over the splits before it tell which holds and the number of its first record.  The lines
of a record are then put together again, also across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record_no, record)`` of one export, numbered from 0 in file order; blank lines are numbered and left out.

    A line break inside quotes stays in its record, a carriage return before the break that ends one goes.
    Quotes are paired by count, as doubled ones are; an odd quote inside an unquoted field is not told from one
    that opens a field."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    inside = Window.partitionBy("block").orderBy("seq")
    before = F.coalesce(F.sum(quotes).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("quotes", quotes).withColumn("odd", before % 2)
    # one row per split: its quotes, and the records that start in it if it begins outside (0) or inside (1) quotes
    splits = lines.groupBy("block").agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("odd") == 0).alias("starts_0"),
                                        F.count_if(F.col("odd") == 1).alias("starts_1"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("enters", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("enters") == 0, F.col("starts_0")).otherwise(F.col("starts_1"))
    splits = splits.withColumn("first", F.coalesce(F.sum(starts).over(earlier), F.lit(0))) \
        .select(F.col("block").alias("split"), "enters", "first")
    placed = lines.join(splits, F.col("block") == F.col("split"))
    begins = (F.col("odd") == F.col("enters")).cast("int")
    no = F.col("first") + F.sum(begins).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1
    whole = placed.select(no.alias("record_no"), "block", "seq", "value").groupBy("record_no").agg(
        F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["value"]), "\n"), "\r$", "")
    return whole.select("record_no", text.alias("record")).where(F.col("record") != "")
