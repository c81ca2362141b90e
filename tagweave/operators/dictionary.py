"""Tag dictionary jobs: canonical names, known tags, year and category
rules, category codes, and the sanitise job (C1) built from them.

The dictionary is a stored table (name is its key): the lookups measure it
and read it, and do not write it again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.categories import UNWANTED_CATEGORY_IDS, code_of_key, is_year_like, is_year_pattern, lookup_key
from .lookup import lookup


def live_tags(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows with ``post_count > 0`` (pushed to the scan when
    the dictionary is a Parquet table)."""
    return dictionary.where(F.col("post_count") > 0)


def alias_map(alias_rows: DataFrame) -> DataFrame:
    """One consequent per antecedent.  Implications (kind 2) were
    applied after aliases and the last row of a file wins, so the row with
    the greatest ``(kind, row_no)`` is kept.  ``max_by`` is an algebraic
    aggregate: partial aggregation before the shuffle keeps a hot
    antecedent cheap."""
    return (alias_rows.groupBy("antecedent_name")
            .agg(F.max_by("consequent_name", F.struct("kind", "row_no")).alias("consequent_name")))


def canonicalize(df: DataFrame, amap: DataFrame, tag: str = "tag", out: str = "canon") -> DataFrame:
    """Replace a tag by its consequent, one hop only (a bounded lookup)."""
    m = amap.select(F.col("antecedent_name").alias("_ante"), F.col("consequent_name").alias("_cons"))
    return (lookup(df, m, F.col(tag), "_ante")
              .withColumn(out, F.coalesce("_cons", F.col(tag))).drop("_ante", "_cons"))


def known_tags(df: DataFrame, dictionary: DataFrame, tag: str = "tag") -> DataFrame:
    """P2/J2 alone: rows whose tag is a live dictionary name (semi join)."""
    live = live_tags(dictionary).select(F.col("name").alias("_name"))
    return lookup(df, live, F.col(tag), "_name", "left_semi", stored=True)


def drop_year_tags(df: DataFrame, tag: str = "tag", rule: str = "observed") -> DataFrame:
    """Drop year-like tags (observed rule: a digit and 4 characters)."""
    pred = is_year_like(F.col(tag)) if rule == "observed" else is_year_pattern(F.col(tag))
    return df.where(~pred)


def drop_categories(df: DataFrame, category: str = "category") -> DataFrame:
    """Drop tags in the unwanted categories (unknown category kept)."""
    c = F.col(category)
    return df.where(c.isNull() | ~c.isin(*UNWANTED_CATEGORY_IDS))


def with_category_code(df: DataFrame, dictionary: DataFrame, tag: str = "tag", out: str = "code",
                       stripped: bool = False) -> DataFrame:
    """Add the category code of each tag (dictionary lookup on the
    lower-cased, stripped tag, then the text heuristics).  ``stripped``
    says the tags are already stripped (saves a pass per tag)."""
    cats = live_tags(dictionary).select(F.col("name").alias("_k"), F.col("category").alias("_cat"))
    keyed = df.withColumn("_key_of", F.lower(F.col(tag)) if stripped else lookup_key(F.col(tag)))
    j = lookup(keyed, cats, F.col("_key_of"), "_k", stored=True)
    return j.withColumn(out, code_of_key(F.col("_key_of"), F.col("_cat"))).drop("_k", "_cat", "_key_of")


def sanitize(captions: DataFrame, dictionary: DataFrame, amap: DataFrame,
             name: str = "name", text: str = "text", year_rule: str = "observed") -> DataFrame:
    """Canonicalise (one hop), drop unknown, year-like and unwanted
    category tags, de-dup keeping the first occurrence after
    canonicalisation.  Every input name stays; a caption that loses all its
    tags becomes ``""``.

    Plan: repeats dropped row-locally (a repeated tag maps to the same
    canonical tag, and only first occurrences count) -> outer posexplode ->
    the alias map and the live dictionary, each read once, by two left
    joins -> the dropped tags turn NULL -> one regroup by name.
    ``collect_list`` combines map-side, so the shuffle carries about one row
    per caption.  Both lookups are bounded ones (``lookup``): measured, then
    broadcast, so no tag row is shuffled before the regroup; beyond the
    bound, only rare tags are shuffled (the frequent ones are broadcast).
    """
    tags = F.array_distinct(tx.split_caption(F.col(text)))
    t = captions.select(F.col(name).alias("name"), F.posexplode_outer(tags).alias("pos", "tag"))
    t = canonicalize(t, amap)
    live = live_tags(dictionary).select(F.col("name").alias("_name"), F.col("category").alias("_cat"))
    t = lookup(t, live, F.col("canon"), "_name", stored=True)
    canon = F.col("canon")
    year = is_year_like(canon) if year_rule == "observed" else is_year_pattern(canon)
    keep = F.col("_name").isNotNull() & ~year & (F.col("_cat").isNull() | ~F.col("_cat").isin(*UNWANTED_CATEGORY_IDS))
    kept = F.when(keep, F.struct(F.col("pos"), canon.alias("canon")))
    g = t.groupBy("name").agg(F.sort_array(F.collect_list(kept)).alias("_k"))
    out = tx.join_tags(F.array_distinct(F.transform("_k", lambda s: s["canon"])))
    return g.select(F.col("name").alias(name), out.alias(text))
