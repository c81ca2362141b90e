"""Caption folders as streams.

The original has no streams; its text rules (T rows), predicates and
dictionary lookups are stateless per caption, so the same Column functions
run on a streaming DataFrame.  Jobs that regroup a caption's tags
(sanitise) are correct per micro-batch because every caption file is whole
in one batch; they run inside ``foreachBatch`` and write one folder per
epoch, so a replayed epoch overwrites its own output (idempotent)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.files import stem_of
from ..session import stage_root

_BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def caption_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New ``.txt`` files of a folder as a stream of ``(file, name, text)``
    (valid UTF-8 only, as in the batch reader).  A file of no bytes never
    comes: Spark's file streams leave it out."""
    r = (spark.readStream.format("binaryFile").schema(_BINARY_SCHEMA)
         .option("pathGlobFilter", "*.[tT][xX][tT]"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    s = r.load(folder).withColumn("file", F.regexp_extract("path", r"([^/]*)$", 1))
    raw = F.col("content").cast("string")
    s = s.where(F.lower("file").endswith(".txt") & F.is_valid_utf8(raw))
    return s.select("file", stem_of(F.col("file")).alias("name"), raw.alias("text"))


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    if given:
        return given
    root = stage_root(spark)
    if not root:
        raise ValueError("no checkpoint location: pass one or set spark.checkpoint.dir")
    return os.path.join(root, "streams", name)


def run_per_batch(stream: DataFrame, job: Callable[[DataFrame], DataFrame], out_path: str, name: str,
                  checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Run a batch job on every micro-batch and write ``out/epoch=<id>``;
    a replayed epoch overwrites its own folder."""
    def each(batch: DataFrame, epoch: int) -> None:
        job(batch).write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch}"))

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation",
                                                     _checkpoint(stream.sparkSession, name, checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
