"""A6 / W3 / S4 on files of any size: content digests read in pieces.

The inventory holds paths and lengths only.  Files of one length can be equal, others can't, so only lengths that
occur twice are read at all, 1 MiB at a time, by the tasks; no file is ever a row."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import MIB, list_files, open_path
from .files import ext_of
from .lookup import lookup


def file_inventory(spark: SparkSession, folder: str, exts: tuple[str, ...] | None = None) -> DataFrame:
    """(path, file, length) of a folder's files, of the (lower-case) extensions where given; no content is read."""
    d = list_files(spark, folder)
    return d if exts is None else d.where(F.lower(ext_of(F.col("file"))).isin(*exts))


def digest_of(path: str, piece: int = MIB) -> str:
    files, at = open_path(path)
    md5 = hashlib.md5()
    with files.open_input_stream(at) as f:
        while data := f.read(piece):
            md5.update(data)
    return md5.hexdigest()


def file_digests(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """``files`` (path, file, length) with ``h``: the MD5 of every file whose length another file has, else null.
    The files to read are dealt out by path, so that a folder's or a length's files don't meet in one task."""
    shared = files.groupBy(F.col("length").alias("_length")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = lookup(files.select("path", "file", "length"), shared, F.col("length"), "_length").drop("_length")

    def run(batches):
        for pdf in batches:
            pdf["h"] = [digest_of(p) for p in pdf["path"]]
            yield pdf[["path", "file", "length", "h"]]

    read = marked.where(F.col("_n").isNotNull()).drop("_n")
    read = read.repartition(tasks, "path") if tasks else read.repartition("path")
    hashed = read.mapInPandas(run, "path string, file string, length bigint, h string")
    alone = marked.where(F.col("_n").isNull()).drop("_n").withColumn("h", F.lit(None).cast("string"))
    return hashed.unionByName(alone)


def keep_move(files: DataFrame) -> DataFrame:
    """Every file of ``file_digests`` with its action: ``keep`` for the first (by name) of its content, else
    ``move``.  The keepers, one row per content, are joined back on (h, file), a key with no skew."""
    h = files.select("file", "length", "h")
    keepers = h.where(F.col("h").isNotNull()).groupBy("h", "length").agg(F.min("file").alias("file")).withColumn("_keep", F.lit(True))
    j = h.join(keepers, ["h", "length", "file"], "left")
    first = F.col("h").isNull() | F.coalesce("_keep", F.lit(False))
    return j.select("file", F.col("length").alias("n_bytes"), F.when(first, "keep").otherwise("move").alias("action"))
