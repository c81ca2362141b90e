"""Parsers for model replies (T16 prune reply, T17 artist reply, T18 tag
reply).  All row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# The markers the parsers look for.
AFTER_HEAD_RX = r"(?is)\*\*Output:\*\*.*?```(.*?)(?:```|\z)"
FENCED_BLOCK_RX = r"(?s)(?U)```(?:\w*\n)?(.+?)```"
REMOVED_RX = r"(?is)(?U)removed\s*(?:are|:)\s*(.+)"
BULLETS_RX = r"(?U)^[\-\*•\s]+"
ARTIST_OUTPUT_MARK = "<|output|>"


def prune_reply_text(reply: Column) -> Column:
    """T16 first half: the text holding the proposed tags -- the fenced
    block after ``**Output:**``, else the first fenced block, else the text
    after "removed are"/"removed:", else the whole reply; leading bullets
    and white space dropped."""
    # after the head: what stands between the next two fences (or after the only one)
    after_head = tx.strip_ws(F.regexp_extract(reply, AFTER_HEAD_RX, 1))
    block = tx.strip_ws(F.regexp_extract(reply, FENCED_BLOCK_RX, 1))
    removed = tx.strip_ws(F.regexp_extract(reply, REMOVED_RX, 1))
    chosen = F.coalesce(*[F.nullif(x, F.lit("")) for x in (after_head, block, removed)], tx.strip_ws(reply))
    return F.regexp_replace(chosen, BULLETS_RX, "")


def parse_prune_reply(reply: Column) -> Column:
    """Proposed tags, split on ``,``, stripped, empties dropped."""
    return tx.comma_pieces(prune_reply_text(reply))


def parse_artist_reply(reply: Column) -> Column:
    """The part after the last ``<|output|>``, split on ``,``,
    stripped, empties dropped, repeats removed in order, joined."""
    last = F.substring_index(reply, ARTIST_OUTPUT_MARK, -1)
    return tx.join_tags(F.array_distinct(tx.comma_pieces(tx.strip_ws(last))))


def parse_tag_reply(reply: Column) -> Column:
    """The reply as the chat client returns it (stripped), then its
    first line, stripped, one leading ``-`` removed, stripped again.  NULL
    for an empty reply (a failed record: ``splitlines()[0]`` raises)."""
    r = tx.strip_ws(reply)
    first = F.regexp_extract(r, r"^([^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]*)", 1)
    cleaned = tx.strip_ws(F.regexp_replace(tx.strip_ws(first), "^-", ""))
    return F.when(F.coalesce(r, F.lit("")) != "", cleaned)
