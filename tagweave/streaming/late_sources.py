"""Merged captions while sources still arrive (A1 on a stream).

A name's captions come from several sources, some of them late.  Each name keeps the sources it has seen in
keyed state; whenever a micro-batch brings a further one, its merged caption is sent again.  The state holds
source number and text only; splitting, ordering and de-duplication are the batch job's own expressions, so
once all sources have come the last caption of every name equals ``merge_captions`` over all of them.

Defined results: a caption that comes twice from one source changes nothing and is not sent again; a source that
sends two different captions for a name keeps both, as in the batch job; a null name is a name of its own; a null
text or source number is kept as it is.  State grows with the distinct captions, as the merged result needs them.
Python sees a name's sources (one row each), never a group of names."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as tx
from ..operators.merge import merged_text
from .captions import run_per_batch

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SOURCES = "array<struct<o:bigint,text:string>>"


class _Sources(StatefulProcessor):
    """A name's sources so far; sends all of them when one is new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("sources", "o bigint, text string", "n int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = {(r["o"], r["text"]) for r in rows}
        new = {x for x in new if not self._seen.containsKey(x)}
        if new:
            for x in new:
                self._seen.updateValue(x, (1,))
            yield Row(name=key[0], s=[Row(o=o, text=t) for o, t in self._seen.keys()])

    def close(self) -> None:
        pass


def merged_stream(sources: DataFrame, name: str = "name", text: str = "text",
                  source_ord: str = "source_ord") -> DataFrame:
    """Streaming ``(name, text)``: a name's merged caption, each time a further source of it has come.  The session's
    state store must be one that keyed state can use (``STATE_STORE``)."""
    rows = sources.select(F.col(name).alias("name"), F.col(source_ord).cast("long").alias("o"), F.col(text).alias("text"))
    seen = rows.groupBy("name").transformWithState(
        statefulProcessor=_Sources(), outputStructType=f"name string, s {_SOURCES}", outputMode="Update", timeMode="None")
    lists = F.sort_array(F.transform("s", lambda x: F.struct(x["o"].alias("o"), tx.split_caption(x["text"]).alias("tags"))))
    return seen.select("name", lists.alias("s")).select(F.col("name").alias(name), merged_text("s").alias(text))


def run_merge(sources: DataFrame, out_path: str, query: str, checkpoint: str | None = None,
              available_now: bool = True) -> StreamingQuery:
    """Write every micro-batch's new merged captions under ``out/epoch=<id>``."""
    return run_per_batch(merged_stream(sources), lambda batch: batch, out_path, query, checkpoint, available_now)


def merged_now(spark: SparkSession, out_path: str) -> DataFrame:
    """(name, text): the last caption written for every name."""
    rows = spark.read.option("basePath", out_path).parquet(os.path.join(out_path, "epoch=*"))
    last = rows.groupBy("name").agg(F.max_by(F.struct("text"), "epoch").alias("last"))
    return last.select("name", "last.text")
