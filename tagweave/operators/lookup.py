"""Bounded lookup: join a large table of facts with a table of unique keys.

The small side is measured before any fact row moves.  Within a stated bound it is broadcast, so the facts
are joined where they are read, with no exchange.  Beyond the bound the facts are written once, and their distinct keys are counted and
looked up, once each; the most frequent ones (null and unknown ones among them) are broadcast with what was found, as
many as the bound holds, and any key that more than ``share`` of the facts carry, at most ``1 / share`` of them.
Only facts of the other, rare keys are shuffled: a small part where few keys carry most facts, as words do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1e-4
ROW_BYTES = 32  # a row's overhead in a broadcast relation


def table_bytes(table: DataFrame) -> int:
    """Size of a table's rows in memory, by one pass over it (pass a written table)."""
    size = F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES
    return int(table.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0])


def lookup(facts: DataFrame, small: DataFrame, key: Column, small_key: str, how: str = "left",
           bound: int = BROADCAST_BYTES, share: float = HOT_SHARE, stored: bool = False) -> DataFrame:
    """``facts`` joined (``how``: left, inner or left_semi) with ``small``, whose ``small_key`` is unique, on
    ``key``.  Column names of the two must differ.  ``stored`` says that ``small`` is read straight from a
    table; anything else is written once, as it is measured and then read.

    A null key meets nothing (the fact stays in a left join, and goes in the others)."""
    table = small if stored else staged(small, "lookup")
    if table_bytes(table) <= bound:
        return facts.join(F.broadcast(table), key == F.col(small_key), how)
    return _beyond(facts, table, key, small_key, how, bound, share)


def _cut(keys: DataFrame, bound: int) -> int | None:
    """Least step of frequency (eighths of a power of two) whose keys and all more frequent ones fit into ``bound``."""
    size = F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES
    steps = keys.groupBy("_step").agg(F.sum(size.cast("long")).alias("b")).collect()  # some hundred rows at most
    least, total = None, 0
    for r in sorted(steps, reverse=True):
        total += r["b"]
        if total > bound:
            break
        least = r["_step"]
    return least


def _beyond(facts: DataFrame, table: DataFrame, key: Column, small_key: str, how: str, bound: int, share: float) -> DataFrame:
    facts = staged(facts, "lookup-facts")  # read three times below, made once
    counts = facts.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_step", F.floor(F.log2("_n") * 8).cast("int"))
    keys = staged(counts.join(table, F.col("_key") == F.col(small_key), "left"), "lookup-keys")
    total = keys.agg(F.sum("_n")).first()[0] or 0
    least = _cut(keys, bound)
    often = F.col("_n") > total * share
    hot = often if least is None else often | (F.col("_step") >= least)
    found = keys.where(hot).drop("_n", "_step").withColumn("_hot", F.lit(True))
    met = facts.join(F.broadcast(found), key.eqNullSafe(F.col("_key")), "left")
    first = met.where(F.col("_hot"))
    if how != "left":
        first = first.where(F.col(small_key).isNotNull())
    first = first.drop("_hot", "_key", *(table.columns if how == "left_semi" else []))
    rest = met.where(F.col("_hot").isNull()).drop("_hot", "_key", *table.columns)
    # a null key is in no table, so a left join keeps its facts wherever it is counted
    return first.unionByName(rest.join(table, key == F.col(small_key), how))
