"""Line de-duplication: a segment-partition edit join, in DataFrame functions only.

Link rule: two lines, whatever they hold, are linked if their edit distance is 1 or less, or ``THRESHOLD`` (2) or less
where the shorter has ``LONG`` (16) characters or more.

A line is cut into t + 1 segments; by the pigeonhole principle a line with at most t edits holds one of them
unchanged.  So every line is indexed under (length, segment number, segment), and probes, for each length
that is shorter by 0..t, the substrings whose start can match that segment after t edits (multi-match-aware
selection: the left part's shift and the right part's shift each leave room for the other segments).
Pairs that share a key but whose letter counts differ by more than 2t in all (t edits can't) are dropped inside
the join, so variants of one line that differ by whole words don't become pairs.  The rest is verified by a
bit-parallel edit distance on the band of 2t + 1 diagonals: one integer per number of errors, one bit per
diagonal, moved over the longer line's characters.

Lines of few letters (under ``LINK_LETTERS``, 8: numbers, dates, brackets, table cells) share segments and letter
counts with most of their kind, so pairs with such a line are found apart: the short ones by their one-character
deletions, which meet for linked lines alone; the long ones by segments again, with digits and signs counted
instead of letters.

Links form classes (connected components of distinct lines).  A class that stands in ``MIN_DOCS`` (10) documents or
more, whatever their number in all, is boilerplate: every line of it with
``CUT_LETTERS`` (16) letters or more goes, but for the corpus's first.  Shorter lines, such as code, table and
list entries, always stay.

Scale: each distinct line is joined once, whatever its number of copies; probe rows per line depend on
t alone; the joins are plain equi-joins, so adaptive execution splits hot keys; linked lines and boilerplate classes
are looked up under a measured bound, so that neither the places of all lines nor whole documents are shuffled
for a few of them; all else is hash aggregation with map-side combine.

Defined results: null text has no lines and stays null; an empty line is never removed; equal lines
are one class; ties of a class's first line go to the smaller doc_id, then line number; rows with null
doc_id come after all others; repeated rows each keep their row (their lines count as of one
document); other columns are kept.  Distances count characters (code points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from .common import staged, unchanged_schema
from .components import components

THRESHOLD = 2
LONG = 16
LINK_LETTERS = 8
CUT_LETTERS = 16
MIN_DOCS = 10


def has_letters(line: str, n: int) -> Column:
    """Does the line hold ``n`` letters or more?  The match ends at the n-th."""
    return F.col(line).rlike(r"^(?:[^\p{L}]*+\p{L}){%d}" % n)


def segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of ``parts``: the last ones take the remainder."""
    size = F.floor(length / parts).cast("int")
    first_longer = F.lit(parts) - (length - size * parts)  # segments from here on are longer by one
    return size * i + F.greatest(F.lit(0), i - first_longer) + 1, size + (i >= first_longer).cast("int")


LETTERS = "etaoinshrdlcumwfgypb"  # 20 letters of 2 bits, frequent ones first
SIGNS = "0123456789 .,-:/|=*_"  # 20 signs, for lines of few letters
STEP = 4


def with_counts(lines: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``lines`` with ``counts``: how often each of 20 letters stands in ``line``, modulo 4, packed into a long.
    The letters are removed one after the other, frequent ones first, so the text soon gets short.  A step removes
    ``STEP`` of them and carries the rest alone, as the driver plans all steps anew for each use of the lines."""
    own = [F.col(c) for c in lines.columns]
    df = lines.withColumns({"rest": F.col("line"), "counts": F.lit(0).cast("long")})
    for first in range(0, len(letters), STEP):
        rest, counts = F.col("rest"), F.col("counts")
        for k, c in enumerate(letters[first:first + STEP], first):
            less = F.replace(rest, F.lit(c), F.lit(""))
            n = (F.octet_length(rest) - F.octet_length(less)).cast("long")
            counts, rest = counts.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(3)), 2 * k)), less
        df = df.select(*own, rest.alias("rest"), counts.alias("counts"))
    return df.drop("rest")


FIELDS = sum(1 << 2 * k for k in range(len(LETTERS)))  # the low bit of each count


def counts_apart(a: Column, b: Column) -> Column:
    """At least so much the counts differ in all; t edits change them by 2t at most.  Modulo 4, two counts are 1 apart
    if their low bits differ, else 2 if their high bits do: two bit counts for all letters."""
    x = a.bitwiseXOR(b)
    two = F.shiftright(x, 1).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(FIELDS))
    return F.bit_count(x.bitwiseAND(F.lit(FIELDS))) + 2 * F.bit_count(two)


def _keyed(lines: DataFrame, places: list[tuple[int, int, int]], t: int) -> DataFrame:
    """(id, counts, key) for each (d, i, shift): of a line's substring that could be segment i of a line shorter by
    d, were it moved by ``shift``.  The places are rows, so the key is one small expression."""
    p = F.explode(F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("d", "i", "shift"), q)]) for q in places]))
    rows = lines.select("id", "line", "n", "counts", p.alias("p"))
    n = F.col("n") - F.col("p.d")
    start, size = segment(n, F.col("p.i"), t + 1)
    at = start + F.col("p.shift")
    # 40 bits of key: what meets by chance is few next to the rows, and verified like any pair
    key = F.shiftrightunsigned(F.xxhash64(n, F.col("p.i"), F.substring("line", at, size)), 24)
    return rows.where((n > 0) & (at >= 1) & (at + size - 1 <= F.col("n"))).select("id", "counts", key.alias("key"))


def index_rows(lines: DataFrame, t: int) -> DataFrame:
    """(id, counts, key) of every segment of ``lines`` (id, line, n, counts)."""
    return _keyed(lines, [(0, i, 0) for i in range(t + 1)], t)


def probe_rows(lines: DataFrame, t: int) -> DataFrame:
    """(id, counts, key) of the substrings that can equal a segment of a line not longer than this one: the shift
    must leave an edit for each of the other segments, on the left (i) and on the right (t - i)."""
    return _keyed(lines, [(d, i, shift) for d in range(t + 1) for i in range(t + 1)
                          for shift in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)], t)


def within(a: Column, b: Column, t: int) -> Column:
    """Is the edit distance of ``a`` and ``b`` (arrays of characters, |a| <= |b|) t or less?

    State r_e: bit t + d is set if a's prefix of length j + d is reachable from b's prefix of length j
    with e edits.  Per character of b: a match keeps the diagonal; a substitution keeps it and an
    insertion moves it down by one at one error more; a deletion moves it up within the step.
    """
    band, full = range(-t, t + 1), (1 << (2 * t + 1)) - 1

    def matches(j: Column) -> Column:
        """Bit t + d: does a's character j + d equal b's character j?"""
        c = F.get(b, j)
        bits = [F.when((j + d >= 0) & (F.get(a, j + d) == c), F.lit(1 << (t + d))).otherwise(F.lit(0)) for d in band]
        out = bits[0]
        for x in bits[1:]:
            out = out.bitwiseOR(x)
        return out

    def step(acc: Column, same: Column) -> Column:
        rows = [acc["r0"].bitwiseAND(same)]
        for e in range(1, t + 1):
            below = acc[f"r{e - 1}"]
            rows.append(acc[f"r{e}"].bitwiseAND(same).bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(
                F.shiftleft(rows[-1], 1)).bitwiseAND(F.lit(full)))
        return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(rows)])

    first = F.struct(*[F.lit(sum(1 << (t + d) for d in range(e + 1))).alias(f"r{e}") for e in range(t + 1)])
    end = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(b) - 1), matches), first, step, lambda acc: acc[f"r{t}"])
    bit = F.pow(F.lit(2.0), (F.lit(t) + F.size(a) - F.size(b)).cast("double")).cast("int")
    return F.when(F.size(b) - F.size(a) <= t, end.bitwiseAND(bit) != 0).otherwise(F.lit(False))


def candidates(lines: DataFrame, t: int, below: int | None = None) -> DataFrame:
    """Distinct (a, b) that share a key; a is the shorter line (or of equal length and smaller id), of under
    ``below`` characters where given."""
    if "counts" not in lines.columns:
        lines = with_counts(lines)
    shorter = lines if below is None else lines.where(F.col("n") < below)
    index, probe = index_rows(shorter, t).alias("i"), probe_rows(lines, t).alias("p")
    alike = counts_apart(F.col("i.counts"), F.col("p.counts")) <= 2 * t
    # the index is the small side, so its rows are hashed and neither side is sorted
    return index.hint("shuffle_hash").join(probe, (F.col("i.key") == F.col("p.key")) & (F.col("i.id") != F.col("p.id")) & alike) \
        .select(F.col("i.id").alias("a"), F.col("p.id").alias("b")).distinct()


def edit_links(lines: DataFrame, t: int = THRESHOLD, below: int | None = None) -> DataFrame:
    """``lines``: (id, line, n), distinct.  (a, b) of all pairs within t edits, once each; only those whose shorter
    line has under ``below`` characters where given."""
    if "counts" not in lines.columns:
        lines = with_counts(lines)
    pairs = candidates(lines, t, below)
    # all columns of ``lines`` are read here too: the same exchange then serves keys and texts
    left, right = (lines.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "line", "n", "counts")]) for x in "ab")
    both = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b")).where(
        ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        & (counts_apart(F.col("counts_a"), F.col("counts_b")) <= 2 * t))
    # cut into characters once per pair: a Generate keeps the arrays out of the lambdas that index them
    chars = both.select("a", "b", F.explode(F.array(F.struct(
        F.split("line_a", "").alias("a"), F.split("line_b", "").alias("b")))).alias("chars"))
    return chars.where(within(F.col("chars.a"), F.col("chars.b"), t)).select("a", "b")


def deletion_links(lines: DataFrame) -> DataFrame:
    """(a, b) of all pairs of ``lines`` (id, line, n) within one edit, once each.  Lines of one length are so if the
    same text is left of both without the character at one place; a shorter line is so if it is what is left of a
    longer one.  Nothing else meets, and what meets at one place differs in that character alone, so a key has no
    more lines than there are characters."""
    rest = lines.select("id", "n", F.posexplode(F.expr(
        "transform(sequence(1, n), i -> concat(substring(line, 1, i - 1), substring(line, i + 1)))")).alias("at", "rest"))
    a, b = rest.alias("a"), rest.alias("b")
    swapped = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.rest") == F.col("b.rest"))
                     & (F.col("a.id") < F.col("b.id")))
    left = rest.select("id", "rest").distinct().alias("b")
    added = lines.alias("a").join(left, F.col("a.line") == F.col("b.rest"))
    return swapped.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).unionByName(
        added.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))


def line_links(lines: DataFrame, t: int = THRESHOLD, few: DataFrame | None = None) -> DataFrame:
    """(a, b) of all pairs of ``lines`` (as ``distinct_lines`` gives them) by the link rule, once each; ``few``: their
    ``few_letter_lines``, where these were taken from the documents already."""
    lettered = lines.where(~F.col("few"))
    long = edit_links(lettered.where(F.col("n") >= LONG), t)
    short = edit_links(lettered.where(F.col("n") <= LONG), 1, below=LONG)
    few = staged(with_counts(few_letter_lines(lines, t) if few is None else few, SIGNS), "few-letters")
    long_few = edit_links(few.where(F.col("n") >= LONG), t)
    short_few = deletion_links(few.where(F.col("n") <= LONG)).join(
        few.where(F.col("n") < LONG).select(F.col("id").alias("a")), "a", "left_semi")
    # written apart: the driver plans a query anew after each of its shuffles, so one of all four ways fills its memory
    of_few = staged(long_few.unionByName(short_few), "few-links")
    # pairs of two lines of 8 letters or little more are found by both ways
    return long.unionByName(short).unionByName(of_few).distinct()


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, no, id, n, line): every line that is not empty.  ``row`` tells rows of one doc_id
    apart by their text; ``id`` is a 64-bit fingerprint of the line (two different lines of n share one
    with probability n^2 / 2^65)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"),
                       F.posexplode(F.split(text, "\n")).alias("no", "line")).where("line != ''") \
        .withColumn("id", F.xxhash64("line")).withColumn("n", F.char_length("line"))


def few_letter_lines(lines: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """(id, line, n) of the lines that can be in a pair with one of few letters: t edits make t letters more at most."""
    return lines.where(~has_letters("line", LINK_LETTERS + t)).groupBy("id").agg(
        F.min("line").alias("line"), F.min("n").alias("n"))


def distinct_lines(docs: DataFrame, letters: int = 0) -> DataFrame:
    """(id, line, n, counts, few) of the distinct lines (of ``letters`` letters or more, where given); ``few``: does it
    hold under ``LINK_LETTERS`` letters?"""
    lines = occurrences(docs)
    if letters > 0:
        lines = lines.where(has_letters("line", letters))
    lines = with_counts(lines.select("id", "line", "n", (~has_letters("line", LINK_LETTERS)).alias("few")))
    return lines.groupBy("id").agg(F.min("line").alias("line"), *[F.min(c).alias(c) for c in ("n", "counts", "few")])


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, letters: int = 0, cut_letters: int = CUT_LETTERS,
                 min_docs: int = MIN_DOCS, min_share: float = 0.0) -> DataFrame:
    """(doc_id, row, no, class_id, degree, removed): every line that is not empty, with the class of its
    text, the number of other texts linked to its own, and whether it goes as boilerplate.  By default all lines are
    linked, and nothing follows the number of documents; a caller may ask for a least number of ``letters`` in linked
    lines, or for a share of the documents that boilerplate must reach besides."""
    seen = occurrences(docs).withColumn("lettered", has_letters("line", cut_letters)).drop("line", "n")
    # the lines of few letters are taken before the shuffle, which spares a second one of all lines
    few = few_letter_lines(occurrences(docs).where(has_letters("line", letters)) if letters > 0 else occurrences(docs), threshold)
    links = staged(line_links(distinct_lines(docs, letters), threshold, few), "line-links")
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    linked = staged(components(links).join(degree, "id").withColumnRenamed("id", "linked_id"), "line-classes")
    placed = staged(lookup(seen, linked, F.col("id"), "linked_id", stored=True).select(
        "doc_id", "row", "no", "lettered", F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("degree", F.lit(0)).alias("degree")), "lines-classed")
    # one row per class and document, then per class: documents and first place (doc_id, then line)
    order = F.coalesce("doc_id", F.lit(2 ** 63 - 1)).cast("decimal(20,0)")
    by_doc = placed.groupBy("class_id", "doc_id").agg(F.min("no").alias("no"))
    place = (order * F.lit(2 ** 31).cast("decimal(11,0)") + F.col("no")).cast("decimal(38,0)")
    least = max(min_docs, int(min_share * docs.count()) + 1) if min_share else min_docs
    common = staged(by_doc.groupBy(F.col("class_id").alias("common_id")).agg(
        F.count("*").alias("n_docs"), F.min(place).alias("first")).where(F.col("n_docs") >= least), "line-common")
    return lookup(placed, common, F.col("class_id"), "common_id", stored=True).select(
        "doc_id", "row", "no", "class_id", "degree",
        (F.coalesce((F.col("first") != place), F.lit(False)) & F.col("lettered")).alias("removed"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its lines' numbers and classes (of lines that are not empty), the links of
    its lines to other texts, the numbers of the lines that go."""
    own = line_classes(docs).groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("no", "class_id", "removed"))).alias("lines"), F.sum("degree").alias("n_links"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"))
    none = F.array().cast("array<struct<no:int,class_id:bigint,removed:boolean>>")
    lines = F.coalesce("lines", none)
    gone = F.filter(lines, lambda x: x["removed"])
    return base.alias("d").join(own.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id"))
                                & (F.col("d.row") == F.col("o.row")), "left").select(
        F.col("d.doc_id"), F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.size(gone).cast("long").alias("n_removed"), F.to_json(F.transform(gone, lambda x: x["no"])).alias("removed_lines"),
        F.to_json(F.transform(lines, lambda x: x["class_id"])).alias("line_classes"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without boilerplate lines; all rows and columns stay.  The cuts are decided first; documents are
    looked up among them by (doc_id, text hash), so those without a cut are not shuffled while the cuts of all
    stay under the bound."""
    key, gone = (unchanged_schema(docs, c) for c in ("line_key", "gone"))
    known = lambda doc, row: F.struct(doc.isNull().alias("none"), F.coalesce(doc, F.lit(0)).alias("doc"), row.alias("row"))
    cut = staged(line_classes(docs).where("removed").groupBy("doc_id", "row").agg(F.collect_set("no").alias(gone))
                 .select(known(F.col("doc_id"), F.col("row")).alias(key), gone), "line-cuts")
    text = F.col("text").cast("string")
    joined = lookup(docs, cut, known(F.col("doc_id").cast("long"), F.xxhash64(text)), key, stored=True)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains(F.col(gone), i)), "\n")
    return joined.select(*[F.when(F.col(gone).isNull(), text).otherwise(kept).alias("text") if c == "text"
                           else F.col(c) for c in docs.columns])
