"""Merging captions from several sources, and the two tag orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.categories import save_rank
from .dictionary import with_category_code


def merged_text(lists: str) -> Column:
    """One caption from a sorted array of (source, tags): all tags in order, repeats removed keeping the first."""
    return tx.join_tags(F.array_distinct(F.flatten(F.transform(lists, lambda x: x["tags"]))))


def merge_captions(sources: DataFrame, name: str = "name", text: str = "text",
                   source_ord: str = "source_ord") -> DataFrame:
    """Per name, the tags of every source that has the name (marker
    stripped, split on ``", "``), concatenated in source order, repeats
    removed keeping the first.  One shuffle by name (union + groupBy, no
    N-way outer join); the list of a name is bounded by its sources."""
    t = sources.select(F.col(name).alias("name"),
                       F.struct(F.col(source_ord).alias("o"), tx.split_caption(F.col(text)).alias("tags")).alias("s"))
    g = t.groupBy("name").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return g.select(F.col("name").alias(name), merged_text("s").alias(text))


def all_names(sources: DataFrame, name: str = "name") -> DataFrame:
    """Names present in any source."""
    return sources.select(name).distinct()


def merge_priority(sources: DataFrame, dictionary: DataFrame, name: str = "name", text: str = "text",
                   source_ord: str = "source_ord") -> DataFrame:
    """A2 + G2: raw text split on ``", "`` (no marker strip), pieces
    stripped, empties dropped, repeats removed keeping the first, then
    sorted by the category code as text and the first position.

    Repeats go before anything is looked up: one shuffle by name gathers a
    name's lists in source order, and only its distinct tags are exploded.
    The lookup is a bounded one and the rows are dealt by name already, so
    the regroup needs no second shuffle."""
    pieces = F.array_distinct(tx.stripped_pieces(F.col(text), tx.DELIM))
    t = sources.select(F.col(name).alias("name"), F.struct(F.col(source_ord).alias("o"), pieces.alias("tags")).alias("s"))
    g = t.groupBy("name").agg(F.sort_array(F.collect_list("s")).alias("s"))
    tags = F.array_distinct(F.flatten(F.transform(F.filter("s", lambda x: x["tags"].isNotNull()), lambda x: x["tags"])))
    t = g.select("name", F.posexplode_outer(tags).alias("pos", "tag"))
    t = with_category_code(t, dictionary, "tag", "code", stripped=True)
    item = F.when(F.col("tag").isNotNull(), F.struct("code", "pos", "tag"))
    g = t.groupBy("name").agg(F.sort_array(F.collect_list(item)).alias("s"))
    return g.select(F.col("name").alias(name), tx.join_tags(F.transform("s", lambda x: x["tag"])).alias(text))


def save_order(tagged: DataFrame, name: str = "name") -> DataFrame:
    """G1 on exploded rows ``(name, pos, tag, code)``: tags of a name in
    save order (char, spec, inv, art, year, gen, meta, rate), stable inside
    a bucket, repeats removed keeping the first."""
    item = F.when(F.col("tag").isNotNull(), F.struct("tag", "pos", "code"))
    g = tagged.groupBy(name).agg(F.collect_list(item).alias("s"))
    firsts = tx.first_per_key(F.col("s"), "tag")
    keyed = F.transform(firsts, lambda x: F.struct(save_rank(x["code"]).alias("r"), x["pos"].alias("pos"),
                                                   x["tag"].alias("tag")))
    return g.select(name, tx.join_tags(F.transform(F.sort_array(keyed), lambda x: x["tag"])).alias("text"))


def keep_only_character(captions: DataFrame, dictionary: DataFrame, trigger: str,
                        name: str = "name", text: str = "text") -> DataFrame:
    """P6 (documented intent): split on ``,``, strip, drop empties; drop
    every character tag except the trigger; trigger tags first, the rest in
    order; no de-dup.  A blank trigger is rejected."""
    trig = trigger.strip().lower()
    if not trig:
        raise ValueError("no trigger tag provided")
    t = captions.select(F.col(name).alias("name"), F.posexplode_outer(tx.comma_pieces(F.col(text))).alias("pos", "tag"))
    t = with_category_code(t, dictionary, "tag", "code", stripped=True)
    is_char = F.col("code") == "char"
    is_trig = is_char & (F.lower("tag") == trig)
    keep = F.col("tag").isNotNull() & (~is_char | is_trig)
    item = F.when(keep, F.struct(F.when(is_trig, 0).otherwise(1).alias("g"), "pos", "tag"))
    g = t.groupBy("name").agg(F.sort_array(F.collect_list(item)).alias("s"))
    return g.select(F.col("name").alias(name), tx.join_tags(F.transform("s", lambda x: x["tag"])).alias(text))
