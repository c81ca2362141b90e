"""Prune job pieces: the guard on proposed tags (J6), removal (J7) and
the prune job (C2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.replies import parse_prune_reply
from .dictionary import with_category_code
from .merge import save_order


def caption_pieces(text: Column) -> Column:
    """Tags of a caption as the prune job reads them: split on ``,``,
    stripped, empties dropped."""
    return tx.comma_pieces(text)


def guard(df: DataFrame, proposals: str, caption_lower: str, out: str) -> DataFrame:
    """Proposals that really occur in the caption, ignoring case;
    the proposal's spelling and order are kept, repeats too.

    The proposals missing from the caption are found with one hash pass
    (``array_except``) and held in their own column; each proposal is then
    checked against that list, so the cost is tags + proposals x missing
    (a model seldom proposes many tags that are not there)."""
    missing = F.array_except(F.array_distinct(F.transform(proposals, F.lower)), F.col(caption_lower))
    d = tx.with_array(df, "_missing", missing)
    return d.withColumn(out, F.filter(proposals, lambda t: ~F.array_contains(F.col("_missing"), F.lower(t)))) \
            .drop("_missing")


def remove_tags(tags: Column, drop: Column) -> Column:
    """Caption tags minus the selected ones (case-sensitive), then
    repeats removed keeping the first -- ``array_except`` does both in one
    hash pass."""
    return F.array_except(tags, F.coalesce(drop, F.array().cast("array<string>")))


def prune_captions(replied: DataFrame, dictionary: DataFrame, name: str = "name", text: str = "text",
                   reply: str = "reply") -> DataFrame:
    """Reply -> proposed tags -> guard -> remove -> save order.

    ``replied(name, text, reply)`` holds each caption with the model's
    answer for it (the model hook keeps the caption on the row, so no join
    is needed).  Every proposal that passes the guard is removed (the review
    step starts with all of them selected).  The save order needs the
    category of every kept tag: one explode, a broadcast dictionary join
    and one regroup by name.
    """
    c = replied.select(F.col(name).alias("name"), caption_pieces(F.col(text)).alias("tags"),
                       F.coalesce(parse_prune_reply(F.col(reply)), F.array().cast("array<string>")).alias("proposed"))
    c = tx.with_array(c, "tags_lower", F.transform("tags", F.lower))
    g = guard(c, "proposed", "tags_lower", "removed")
    kept = g.select("name", F.posexplode_outer(remove_tags(F.col("tags"), F.col("removed"))).alias("pos", "tag"))
    return save_order(with_category_code(kept, dictionary, stripped=True))
