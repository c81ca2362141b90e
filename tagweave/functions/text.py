"""Column -> Column rules for caption text.

Python's ``str.strip``/``split``/``\\s``/``\\d`` are Unicode aware; Java's
regex classes are ASCII unless ``(?U)`` is given, so every pattern here
carries it.  White space is stripped with the built-in ``trim`` over the
Unicode white-space set: one expression node that names its argument once,
so nested rules stay small.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The end-of-turn marker, the caption delimiter and the
# timestamp / year shapes of a raw post header.
EOT_MARKER_RX = r"<\|eot_id\|>"
DELIM = ", "
TIMESTAMP_RX = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"

# The Unicode White_Space characters (what Python's
# ``str.strip`` and Java's ``(?U)\s`` remove).
WHITE_SPACE = ["\t", "\n", "\x0b", "\x0c", "\r", " ", "\x85", "\xa0", "\u1680", "\u2000", "\u2001", "\u2002",
               "\u2003", "\u2004", "\u2005", "\u2006", "\u2007", "\u2008", "\u2009", "\u200a", "\u2028", "\u2029",
               "\u202f", "\u205f", "\u3000"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_array(df, name: str, expr: Column):
    """Add ``expr`` as column ``name``, computed once per row.

    Catalyst collapses adjacent projections and would copy ``expr`` into
    any lambda that refers to ``name``, re-evaluating it for every array
    element.  A one-element explode is a Generate node, which projections
    are not collapsed through, so the lambda reads the value instead."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def first_per_key(items: Column, key: str) -> Column:
    """One element per ``key`` from an array of structs whose first field is
    ``key``: the smallest struct of each key (by the remaining fields).

    Sort-based, O(n log n): ``array_distinct`` on structs compares pairs
    (structs have no hash equality), which is quadratic in the array size.
    The sorted array is zipped with itself shifted by one; both are
    arguments, so no lambda refers to a computed array."""
    srt = F.sort_array(items)
    pairs = F.zip_with(srt, F.concat(F.slice(srt, 1, 1), srt),
                       lambda c, p: F.struct(c.alias("c"), p[key].alias("pk")))
    firsts = F.filter(pairs, lambda x, i: x["c"].isNotNull() & ((i == 0) | (x["pk"] != x["c"][key])))
    return F.transform(firsts, lambda x: x["c"])


def strip_ws(c) -> Column:
    """Python ``str.strip()``."""
    return F.trim(col(c), F.lit("".join(WHITE_SPACE)))


def rstrip_ws(c) -> Column:
    """Python ``str.rstrip()``."""
    return F.rtrim(col(c), F.lit("".join(WHITE_SPACE)))


def strip_eot(c) -> Column:
    """Right-strip, then drop one trailing end-of-turn marker with the
    white space before it."""
    return F.regexp_replace(rstrip_ws(c), r"(?U)\s*" + EOT_MARKER_RX + "$", "")


def split_tags(c) -> Column:
    """Right-strip and split on ``", "``; pieces are not trimmed and
    ``""`` gives ``[""]``."""
    return F.split(rstrip_ws(c), DELIM, -1)


def split_caption(c) -> Column:
    """T1 then T2: the tag list of a stored caption."""
    return split_tags(strip_eot(c))


def dedup_order(arr) -> Column:
    """Drop repeats, keep the first occurrence (``array_distinct`` keeps
    first-occurrence order)."""
    return F.array_distinct(col(arr))


def join_tags(arr) -> Column:
    return F.array_join(col(arr), DELIM)


def after_last_colon(t: Column) -> Column:
    return F.when(t.contains(":"), strip_ws(F.substring_index(t, ":", -1))).otherwise(t)


def basic_clean(c) -> Column:
    """T4: strip marker, split, keep the text after the last ``:``, de-dup."""
    tags = F.transform(split_caption(c), after_last_colon)
    return join_tags(dedup_order(tags))


def pad_only(c) -> Column:
    """T5: white-space runs inside each tag become ``_``; no de-dup."""
    tags = F.transform(split_caption(c), lambda t: F.regexp_replace(t, r"(?U)\s+", "_"))
    return join_tags(tags)


def stripped_pieces(c, delim: str) -> Column:
    """``[p.strip() for p in c.split(delim) if p.strip()]`` without a
    lambda: the split pattern takes the white space around each delimiter,
    and the white space at both ends of the text, with it; empty pieces are
    removed with ``array_remove`` (all built-in, no per-element
    interpreted function)."""
    d = re.escape(delim).replace(r"\ ", " ")
    rx = r"(?U)^\s+|\s*" + d + r"\s*|\s+$"
    return F.array_remove(F.split(col(c), rx, -1), "")


def comma_pieces(c) -> Column:
    """Split on ``,``, strip each piece, drop empty pieces."""
    return stripped_pieces(c, ",")


def normalize_delimiters(c) -> Column:
    """``", ".join(t.strip() for t in s.split(",") if t.strip())``."""
    return join_tags(comma_pieces(c))


def keyword_clean(c, keyword: str) -> Column:
    """T7 on a non-blank caption: ``_`` -> space, ``\\`` dropped, stripped;
    keyword first when absent; newline at the end.  Blank captions are
    filtered by the caller (the reference skips them)."""
    raw = strip_ws(c)
    pieces = F.filter(F.split(raw, DELIM, -1), lambda t: strip_ws(t) != "")
    cleaned = F.transform(
        pieces, lambda t: strip_ws(F.replace(F.replace(t, F.lit("_"), F.lit(" ")), F.lit("\\"), F.lit(""))))
    kw = F.lit(keyword)
    tags = F.when(F.array_contains(cleaned, kw), cleaned).otherwise(F.array_prepend(cleaned, kw))
    return F.concat(join_tags(tags), F.lit("\n"))


def is_blank(c) -> Column:
    return strip_ws(c) == ""


def locate_from(sub: str, s: Column, pos: Column) -> Column:
    """1-based position of ``sub`` at or after ``pos`` (0 when absent)."""
    return F.call_function("locate", F.lit(sub), s, F.greatest(pos, F.lit(1)))


def restored_stem(stem) -> Column:
    """Cut the stem before the first ``-`` after ``frame_``, else after
    the first ``=``, else keep it."""
    s = col(stem)
    pos_frame = F.locate("frame_", s)
    dash_f = locate_from("-", s, pos_frame)
    pos_eq = F.locate("=", s)
    dash_e = locate_from("-", s, pos_eq)
    return (F.when((pos_frame > 0) & (dash_f > 0), F.substring(s, F.lit(1), dash_f - 1))
             .when(pos_frame > 0, s)
             .when((pos_eq > 0) & (dash_e > 0), F.substring(s, F.lit(1), dash_e - 1))
             .otherwise(s))


def _whole_word_rx(word: Column) -> Column:
    """``(?iuU)\\b<literal>\\b`` (Unicode word boundaries on every Java
    version); ``\\E`` inside the word is split out so the quoting cannot be
    closed early."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(r"(?iuU)\b"), quoted, F.lit(r"\b"))


def contains_word(text, word) -> Column:
    return F.regexp_like(col(text), _whole_word_rx(col(word)))


def inject_artist_year(text, artist, year) -> Column:
    """Put ``"<artist>, <year>, "`` (lower-cased, stripped) after the
    first ``", "`` of the caption, or in front; unchanged when both already
    occur as whole words, ignoring case."""
    t = col(text)
    a = F.lower(strip_ws(artist))
    y = F.lower(strip_ws(year))
    has_both = contains_word(t, a) & contains_word(t, y)
    first = F.locate(DELIM, t)
    insert = F.concat(a, F.lit(DELIM), y, F.lit(DELIM))
    spliced = F.when(
        first > 0,
        F.concat(F.substring(t, F.lit(1), first + 1), insert, F.substring(t, first + 2, F.length(t) + 1)),
    ).otherwise(F.concat(insert, t))
    return F.when(has_both, t).otherwise(spliced)


# The first 4-digit piece of ``", "``-joined pieces: what stands before it,
# the year itself, and what stands after it.
YEAR_SPLIT_RX = r"(?sU)^(?:(.*?), )?(\d{4})(?:, (.*))?$"


def _around_year(pieces: Column, group: int) -> Column:
    """Group 1 (before), 2 (the year) or 3 (after) of the first 4-digit
    piece; ``""`` when there is none."""
    return F.regexp_extract(join_tags(pieces), YEAR_SPLIT_RX, group)


def _as_uploader(before: Column) -> Column:
    """The last piece before the year, in lower case with ``_`` for blanks."""
    return F.replace(F.lower(F.substring_index(before, DELIM, -1)), F.lit(" "), F.lit("_"))


def uploader_year(raw) -> Column:
    """``"<uploader>, <year>"`` from a raw post, NULL when the record
    is skipped (fewer than 3 pieces or no piece before the year)."""
    after = F.regexp_replace(col(raw), r"^(?:[^,]*,[, \t\n]*|[ \t\n]+(?=[^,]*$))", "")
    parts = stripped_pieces(after, DELIM)
    before = _around_year(parts, 1)
    return F.when((F.size(parts) >= 3) & (before != ""),
                  F.concat(_as_uploader(before), F.lit(DELIM), _around_year(parts, 2)))


def post_header_body(raw) -> Column:
    """``struct(uploader, body)`` of a raw post.

    The header starts after the first comma and the ``,``/white space after
    it, and ends at the first timestamp.  Uploader is the piece before the
    first 4-digit piece (``""`` when there is none); body is the text after
    the year up to the timestamp, with ``", "`` and white space stripped.
    """
    header = F.regexp_extract(col(raw), r"(?sU)^(?:[^,]*,)?[,\s]*+(.*?)(?:" + TIMESTAMP_RX + r".*)?$", 1)
    parts = stripped_pieces(header, DELIM)
    body = strip_ws(F.trim(_around_year(parts, 3), F.lit(DELIM)))
    return F.struct(_as_uploader(_around_year(parts, 1)).alias("uploader"), body.alias("body"))


def prepend_trigger(text, trigger: str) -> Column:
    """``"<trigger>, "`` in front unless the text already starts with
    the trigger (a prefix test, as observed); empty trigger: unchanged."""
    t = col(text)
    if trigger == "":
        return t
    return F.when(t.startswith(trigger), t).otherwise(F.concat(F.lit(trigger + DELIM), t))
