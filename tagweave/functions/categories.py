"""Tag category codes and the two sort orders built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip_ws

# Dictionary category ids and what they mean here.
UNWANTED_CATEGORY_IDS = (1, 3, 4, 6, 7)  # artist, copyright, character, invalid, lore
CATEGORY_ID_CODES = {4: "char", 5: "spec", 6: "inv", 1: "art"}
# Save order of the pruned captions (the "year" bucket never
# fills because bare years are classed "meta").
SAVE_ORDER = ("char", "spec", "inv", "art", "year", "gen", "meta", "rate")


def lookup_key(tag) -> Column:
    """Dictionary key of a tag in the category lookup: lower-cased, stripped."""
    return F.lower(strip_ws(tag))


def category_code(tag, category_id) -> Column:
    """The code of a tag given its dictionary category id (NULL when
    the tag is not in the dictionary)."""
    return code_of_key(lookup_key(tag), category_id)


def code_of_key(key, category_id) -> Column:
    """T12 for a tag whose ``lookup_key`` is at hand (worked out once per tag)."""
    t = col(key)
    cid = col(category_id)
    expr = None
    for k, v in CATEGORY_ID_CODES.items():
        expr = F.when(cid == k, v) if expr is None else expr.when(cid == k, v)
    return (expr.when((F.length(t) == 4) & t.rlike(r"(?U)^\d{4}$"), "meta")
                .when(t.startswith("meta:"), "meta")
                .when(t.startswith("rating:"), "rate")
                .otherwise("gen"))


def save_rank(code) -> Column:
    """G1 rank of a category code."""
    c = col(code)
    expr = None
    for i, v in enumerate(SAVE_ORDER):
        expr = F.when(c == v, i) if expr is None else expr.when(c == v, i)
    return expr


def is_year_like(tag) -> Column:
    """P3 (observed rule): any digit and exactly 4 characters."""
    t = col(tag)
    return (F.length(t) == 4) & t.rlike(r"(?U)\d")


def is_year_pattern(tag) -> Column:
    """P3 stricter variant (the unused pattern), selectable by option."""
    return col(tag).rlike(r"^(19|20)\d{2}$")
