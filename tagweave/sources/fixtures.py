"""Caption-curation inputs derived from the driver's parquet tables.

The reference reads folders of caption files, dictionary exports, post
metadata and model scores; the test tables hold prose, vectors and events.
Each function here derives one of the reference's input shapes from a
table with Spark, over the whole table and the whole text of every row, so
the work of every query grows with the data.  Row variety (a marker here, a
missing artist there) comes from ``CASE`` expressions on row attributes;
no rows are filtered away to keep things small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import with_array
from ..session import stage_root

WORD_RX = r"\p{L}+"


def small_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows of job configuration as a literal table.  Built from a
    literal array (not ``createDataFrame``) so that the planner knows its
    size and a broadcast size check can succeed."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Every word (run of Unicode letters, any length) of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RX), 0)


def image_name(doc_id: Column) -> Column:
    return F.concat(F.lit("img_"), F.lpad(doc_id.cast("string"), 10, "0"))


def captions(spark, sf_dir) -> DataFrame:
    """F1 ``(name, text, doc_id)``: one caption per document, every word a
    tag; words whose length is a multiple of 5 carry a ``meta:`` prefix and
    every third document ends in an end-of-turn marker."""
    d = table(spark, sf_dir, "documents")
    tags = F.transform(words(F.col("text")),
                       lambda x: F.when(F.length(x) % 5 == 0, F.concat(F.lit("meta:"), x)).otherwise(x))
    text = F.concat(F.array_join(tags, ", "),
                    F.when(F.col("doc_id") % 3 == 0, F.lit(" <|eot_id|> ")).otherwise(F.lit("")))
    return d.select(image_name(F.col("doc_id")).alias("name"), text.alias("text"), "doc_id")


def plain_captions(spark, sf_dir) -> DataFrame:
    """F1 without prefixes, for the dictionary jobs: every word of the
    document, plus ``2014, 4leg`` on every sixth (year rule) and the marker
    on every third."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.array_join(words(F.col("text")), ", "),
                    F.when(F.col("doc_id") % 6 == 0, F.lit(", 2014, 4leg")).otherwise(F.lit("")),
                    F.when(F.col("doc_id") % 3 == 0, F.lit(" <|eot_id|> ")).otherwise(F.lit("")))
    return d.select(image_name(F.col("doc_id")).alias("name"), text.alias("text"), "doc_id")


_STORED: dict[tuple[str, str], str] = {}


def dictionary(spark, sf_dir) -> DataFrame:
    """F2 as the stored table it is in real use: written once per session and
    table folder, then read from Parquet (``post_count > 0`` is pushed to
    its scan)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{stage_root(spark)}/dictionary-{uuid.uuid4().hex}"
        _corpus_dictionary(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return spark.read.schema("name string, category int, post_count bigint").parquet(_STORED[key])


def _corpus_dictionary(spark, sf_dir) -> DataFrame:
    """F2 ``(name, category, post_count)``: every word of the corpus with a
    category from its spelling and ``post_count = occurrences - 1`` (words
    seen once are dead entries).  Two year-shaped names are added so that
    the year rule, not the unknown-tag rule, is what drops them."""
    d = table(spark, sf_dir, "documents")
    w = d.select(F.explode(words(F.col("text"))).alias("name"))
    dic = w.groupBy("name").agg((F.count(F.lit(1)) - 1).alias("post_count"))
    dic = dic.select("name", ((F.length("name") + F.ascii("name")) % 9).cast("int").alias("category"),
                     F.col("post_count").cast("bigint").alias("post_count"))
    extra = small_table(spark, [("2014", 0, 1), ("4leg", 0, 1)], ["name", "category", "post_count"])
    extra = extra.select("name", F.col("category").cast("int"), F.col("post_count").cast("bigint"))
    return dic.unionByName(extra)


def alias_rows(spark, sf_dir) -> DataFrame:
    """F3 ``(antecedent_name, consequent_name, kind, row_no)`` as the alias
    (kind 1) and implication (kind 2) exports would hold them.  Some alias
    antecedents get a second, later row so that "last row wins" shows.
    One pass over the dictionary."""
    n = F.col("name")
    last = F.ascii(F.substring(n, -1, 1))
    cand = F.array(
        F.when((F.length(n) >= 6) & (last % 2 == 0),
               F.struct(F.expr("substring(name, 1, length(name) - 1)").alias("c"), F.lit(1).alias("k"), F.lit(1).alias("r"))),
        F.when((F.length(n) >= 7) & (last % 4 == 0),
               F.struct(F.expr("substring(name, 1, length(name) - 2)").alias("c"), F.lit(1).alias("k"), F.lit(2).alias("r"))),
        F.when((F.length(n) >= 8) & (F.ascii(n) % 4 == 1),
               F.struct(F.substring(n, 1, 3).alias("c"), F.lit(2).alias("k"), F.lit(1).alias("r"))))
    x = dictionary(spark, sf_dir).select(n.alias("antecedent_name"), F.explode(cand).alias("x")).where(F.col("x").isNotNull())
    return x.select("antecedent_name", F.col("x.c").alias("consequent_name"), F.col("x.k").alias("kind"),
                    F.col("x.r").cast("bigint").alias("row_no"))


def _post_items() -> Column:
    """The posts of a document, in order: one pointing 20 names ahead (so the
    last 20 have no caption; every tenth has no artist), and for German
    documents two more, equal ones by an artist whose name ends in a bracket
    (a name that never counts as present, so the repeat changes the caption
    again)."""
    fn = image_name(F.col("doc_id") + 20)
    yr = (F.lit(2000) + F.col("doc_id") % 25).cast("string")

    def post(k: int, artist: Column) -> Column:
        return F.struct((F.col("doc_id") * 3 + k).alias("post_id"), fn.alias("filename"), artist.alias("artist"), yr.alias("year"))

    first = F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("Artist "), F.col("source")))
    studio = F.concat(F.lit("Studio ("), F.col("lang"), F.lit(")"))
    return F.when(F.col("lang") == "de", F.array(post(0, first), post(1, studio), post(2, studio))) \
            .otherwise(F.array(post(0, first)))


def posts(spark, sf_dir) -> DataFrame:
    """F4 ``(post_id, filename, artist, year)``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(_post_items()).alias("p")).select("p.*")


def post_meta(spark, sf_dir) -> DataFrame:
    """F4 as post-metadata files ``(file, text)``: a JSON object of posts per
    document, with two values that are not posts."""
    d = table(spark, sf_dir, "documents").withColumn("_posts", _post_items())
    one = F.transform("_posts", lambda p: F.concat(
        F.lit('"'), p["post_id"].cast("string"), F.lit('": '),
        F.to_json(F.struct(p["artist"].alias("artist"), p["year"].cast("int").alias("year"), p["filename"].alias("filename")))))
    text = F.concat(F.lit("{"), F.array_join(one, ", "), F.lit(', "scraper": "v2", "n": 1}'))
    return d.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".json")).alias("file"), text.alias("text"))


def raw_posts(spark, sf_dir) -> DataFrame:
    """F8 ``(event_id, event_type, raw)``: a raw post header per event."""
    e = table(spark, sf_dir, "events")
    raw = F.concat(
        F.lit("post "), F.col("event_id").cast("string"), F.lit(",, "), F.col("event_type"), F.lit(" no "),
        F.col("event_id").cast("string"), F.lit(", "), F.col("event_type"), F.lit(" User"),
        F.col("user_id").cast("string"), F.lit(", "),
        F.when(F.col("event_id") % 7 == 0, F.lit("n.d.")).otherwise((F.lit(2000) + F.col("event_id") % 25).cast("string")),
        F.lit(", "), F.col("props"), F.lit(", "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(", end"))
    return e.select("event_id", "event_type", raw.alias("raw"))


def replies(spark, sf_dir) -> DataFrame:
    """F9 ``(conv_id, turn, role, reply)``: model replies in the four forms
    the prune parser knows, built from every word of the turn's text."""
    c = table(spark, sf_dir, "conversations")
    w = F.array_join(words(F.col("text")), ", ")
    t = F.col("turn") % 4
    reply = (F.when(t == 0, F.concat(F.lit("Sure.\n**Output:**\n```\n- "), w, F.lit("\n```\nDone")))
              .when(t == 1, F.concat(F.lit("```text\n"), w, F.lit("```")))
              .when(t == 2, F.concat(F.lit("The tags removed are "), w))
              .otherwise(w))
    return c.select("conv_id", "turn", "role", reply.alias("reply"))


def artist_replies(spark, sf_dir) -> DataFrame:
    """F9 for the artist parser, every turn: the echoed prompt, the mark, and
    every word of the turn with the first one again."""
    c = table(spark, sf_dir, "conversations")
    w = words(F.col("text"))
    reply = F.concat(F.lit("prompt "), F.col("conv_id").cast("string"), F.lit("\n<|output|>\n"),
                     F.array_join(w, ", "), F.lit(", "), F.coalesce(F.get(w, 0), F.lit("")))
    return c.select("conv_id", "turn", reply.alias("reply"))


def turn_captions(spark, sf_dir) -> DataFrame:
    """``(conv_id, turn, text)``: a caption per turn, the turn's words of odd
    length, first vowels as capitals (the guard ignores case)."""
    c = table(spark, sf_dir, "conversations")
    w = F.filter(words(F.col("text")), lambda x: F.length(x) % 2 == 1)
    w = F.transform(w, lambda x: F.concat(F.translate(F.substring(x, 1, 1), "aeiou", "AEIOU"), F.substring(x, 2, 1_000_000)))
    return c.select("conv_id", "turn", F.array_join(w, ", ").alias("text"))


def file_names(spark, sf_dir) -> DataFrame:
    """F7 ``(page_id, stem, ext)``: stems in the shapes the name restorer
    knows; neighbouring pages of the first two shapes restore to one name."""
    p = table(spark, sf_dir, "pages")
    pid = F.when(F.col("page_id") % 4 < 2, F.floor(F.col("page_id") / 8)).otherwise(F.col("page_id")).cast("string")
    m = F.col("page_id") % 4
    stem = (F.when(m == 0, F.concat(F.lit("clip_frame_"), pid, F.lit("-up2x-"), F.length("html").cast("string")))
             .when(m == 1, F.concat(F.lit("a-b="), pid, F.lit("-x"), F.length("html").cast("string")))
             .when(m == 2, F.concat(F.lit("plain-"), pid))
             .otherwise(F.concat(F.lit("k="), pid)))
    ext = F.when(F.col("page_id") % 2 == 0, F.lit(".png")).otherwise(F.lit(".txt"))
    return p.select("page_id", stem.alias("stem"), ext.alias("ext"))


def image_files(spark, sf_dir) -> DataFrame:
    """F10 ``(doc_id, file, content)``: an image inventory; the text stands
    in for the bytes (exact copies in the corpus make duplicate files)."""
    d = table(spark, sf_dir, "documents")
    ext = (F.when(F.col("doc_id") % 5 == 0, ".png").when(F.col("doc_id") % 5 == 1, ".JPG")
            .when(F.col("doc_id") % 5 == 2, ".webp").when(F.col("doc_id") % 5 == 3, ".gif").otherwise(".pdf"))
    return d.select("doc_id", F.concat(image_name(F.col("doc_id")), ext).alias("file"),
                    F.encode(F.col("text"), "UTF-8").alias("content"))


def source_tags(spark, sf_dir) -> DataFrame:
    """F15 ``(doc_id, name, source_ord, tags)``: three taggers over every
    word of each document.  Tagger 1 keeps short words, tagger 2 words of 5
    or more letters, tagger 3 words holding an ``e``; tagger 2 does not
    cover German and tagger 3 not Spanish, so some names are missing from
    some sources."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", words(F.col("text")).alias("w"))
    d = with_array(d, "words", F.col("w"))  # read and cut into words once for the three

    def tagger(k: int, tags: Column) -> Column:
        return F.struct(F.lit(k).alias("source_ord"), tags.alias("tags"))

    each = F.array(
        tagger(1, F.filter("words", lambda x: F.length(x) <= 6)),
        F.when(F.col("lang") != "de", tagger(2, F.filter("words", lambda x: F.length(x) >= 5))),
        F.when(F.col("lang") != "es", tagger(3, F.filter("words", lambda x: x.contains("e")))))
    out = d.select("doc_id", F.explode(F.array_compact(each)).alias("s"))
    return out.select("doc_id", image_name(F.col("doc_id")).alias("name"), "s.source_ord", "s.tags")


def source_captions(spark, sf_dir) -> DataFrame:
    """F15 as caption text ``(source, source_ord, name, text)``; the second
    tagger writes an end-of-turn marker, the first leaves empty files."""
    st = source_tags(spark, sf_dir)
    text = F.concat(F.array_join("tags", ", "),
                    F.when(F.col("source_ord") == 2, F.lit(" <|eot_id|>\n")).otherwise(F.lit("")))
    return st.select(F.concat(F.lit("tagger"), F.col("source_ord").cast("string")).alias("source"),
                     "source_ord", "name", text.alias("text"))


# The two scoring models of the score fixtures and their label
# ranges (they overlap on labels 24-39, so a mean runs over one or two).
SCORE_MODELS = [("m1", 0, 39), ("m2", 24, 63)]


def score_models(spark) -> DataFrame:
    return small_table(spark, SCORE_MODELS, ["model", "lo", "hi"])


def micro(v: Column) -> Column:
    """Integer form of a score in [-1, 1]: exact across engines."""
    return F.floor((v.cast("double") + 1) * 500000).cast("bigint")


def vocabulary(spark, sf_dir) -> DataFrame:
    """F11 ``(model, idx, tag)``: one label per vector dimension present in
    the data that falls in the model's range; ``idx`` is the position in
    the model's output, the text names the dimension, and every 13th
    dimension has the same text (a repeated label)."""
    e = table(spark, sf_dir, "embeddings")
    dims = e.select(F.posexplode("embedding").alias("g", "_v")).select("g").distinct()
    lab = score_models(spark).select("model", "lo", F.explode(F.sequence("lo", "hi")).alias("g"))
    lab = lab.join(dims, "g", "left_semi")
    tag = F.when(F.col("g") % 13 == 0, F.lit("dup tag")).otherwise(F.concat(F.lit("tag_"), F.col("g").cast("string")))
    return lab.select("model", (F.col("g") - F.col("lo")).cast("int").alias("idx"), tag.alias("tag"))


def head_weights(spark, n_labels: int, n_dims: int = 64) -> DataFrame:
    """F12 ``(l, e, w)``: head weights from a rule, ``w`` in [-1, 1]."""
    r = spark.range(n_labels * n_dims)
    l = (F.col("id") / n_dims).cast("int")
    e = (F.col("id") % n_dims).cast("int")
    return r.select(l.alias("l"), e.alias("e"), (((l * 31 + e * 17) % 21 - 10) / 10.0).alias("w"))


def heat_cells(spark, sf_dir) -> DataFrame:
    """F13 ``(image, tag, model, cell, v)``: each vector as 4 models' maps
    of 16 cells, values in integer micro-units; every 11th vector gives flat
    maps."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    x = x.withColumn("v", F.when(F.col("vec_id") % 11 == 0, F.lit(0.25)).otherwise(F.col("v").cast("double")))
    return x.select(F.col("vec_id").alias("image"), F.concat(F.lit("tag_"), F.col("label").cast("string")).alias("tag"),
                    (F.col("pos") / 16).cast("int").alias("model"), (F.col("pos") % 16).cast("int").alias("cell"),
                    micro(F.col("v")).alias("v"))


def patch_values(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """F16 stored activations ``(image, patch, e, a)`` and gradients
    ``(image, patch, e, g)``: four vectors make one image of 4 patches;
    dims 0-31 are activations, 32-63 gradients, as ``floor(v * 10000)``."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select((F.col("vec_id") / 4).cast("long").alias("image"), (F.col("vec_id") % 4).cast("int").alias("patch"),
                 F.posexplode("embedding").alias("pos", "v"))
    x = x.withColumn("q", F.floor(F.col("v").cast("double") * 10000).cast("bigint"))
    acts = x.where(F.col("pos") < 32).select("image", "patch", F.col("pos").alias("e"), F.col("q").alias("a"))
    grads = x.where(F.col("pos") >= 32).select("image", "patch", (F.col("pos") - 32).alias("e"), F.col("q").alias("g"))
    return acts, grads


def scrape_files(spark, sf_dir) -> DataFrame:
    """A scrape folder ``(file, text)`` from ``pages``: one image per page
    (``.png`` for even ids, ``.jpg`` for odd), a JSON sidecar for four pages
    in five (tags as a list, keywords as a string, an empty tag list with
    keywords, or broken JSON), and a text sidecar (the URL) for even ids; the
    tags are every word of the page."""
    p = table(spark, sf_dir, "pages")
    stem = F.concat(F.lit("page_"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    w = words(F.col("html"))
    tag_list = F.when(F.size(w) == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.array_join(w, '", "'), F.lit('"]')))
    m = F.col("page_id") % 5
    js = (F.when(m == 0, F.concat(F.lit('{"tags": '), tag_list, F.lit("}")))
           .when(m == 1, F.concat(F.lit('{"keywords": "'), F.array_join(w, " ,"), F.lit('"}')))
           .when(m == 2, F.concat(F.lit('{"tags": [], "keywords": ["k_'), F.col("page_id").cast("string"), F.lit('"]}')))
           .when(m == 3, F.lit('{"tags": [')))
    img = F.concat(stem, F.when(F.col("page_id") % 2 == 0, F.lit(".png")).otherwise(F.lit(".jpg")))
    cand = F.array(
        F.struct(img.alias("file"), F.lit(None).cast("string").alias("text")),
        F.when(js.isNotNull(), F.struct(F.concat(stem, F.lit(".json")).alias("file"), js.alias("text"))),
        F.when(F.col("page_id") % 2 == 0, F.struct(F.concat(stem, F.lit(".txt")).alias("file"), F.col("url").alias("text"))))
    x = p.select(F.explode(cand).alias("f")).where(F.col("f").isNotNull())
    return x.select("f.file", "f.text")


def caption_bytes(spark, sf_dir) -> DataFrame:
    """Caption files as bytes ``(file, content)``: the F1 captions encoded as
    UTF-8; every seventh file gets an invalid byte sequence spliced in after
    its first tag (an encoding accident)."""
    c = captions(spark, sf_dir)
    first = F.substring_index("text", ", ", 1)
    rest = F.expr("substring(text, length(substring_index(text, ', ', 1)) + 1)")
    bad = F.concat(F.encode(first, "UTF-8"), F.unhex(F.lit("FFFE")), F.encode(rest, "UTF-8"))
    content = F.when(F.col("doc_id") % 7 == 0, bad).otherwise(F.encode("text", "UTF-8"))
    return c.select(F.concat("name", F.lit(".txt")).alias("file"), content.alias("content"))
