"""Post metadata -> captions (J5 with T9 folded per caption)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

POST_FIELDS = "artist string, year string, filename string"


def parse_post_meta(json_text: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A post-metadata JSON object (id -> object) per row -> one row per
    post ``(*keep, post_no, post_key, artist, year, filename)``; ``post_no``
    is the post's place in its object (posts are applied in that order).
    Values that are not JSON objects are dropped; numbers are read as their
    text; a JSON null field stays NULL (and the post is then skipped by the
    injector)."""
    m = F.from_json(F.col(text), "map<string,string>")
    e = json_text.select(*keep, F.posexplode(F.map_entries(m)).alias("post_no", "e"))
    e = e.select(*keep, "post_no", F.col("e.key").alias("post_key"), F.col("e.value").alias("v"))
    e = e.where(F.regexp_like(F.col("v"), F.lit(r"^\s*\{")))
    return e.select(*keep, "post_no", "post_key", F.from_json("v", POST_FIELDS).alias("p")).select(
        *keep, "post_no", "post_key", "p.*")


def _valid(posts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return posts.select(
        F.struct(*order).alias("at"),
        tx.strip_ws(F.col("artist")).alias("artist"),
        tx.strip_ws(F.col("year")).alias("year"),
        tx.strip_ws(F.col("filename")).alias("filename"),
    )


def _ok(c="artist", y="year", f="filename"):
    return (F.coalesce(F.col(c), F.lit("")) != "") & (F.coalesce(F.col(y), F.lit("")) != "") & \
           (F.coalesce(F.col(f), F.lit("")) != "")


def inject_posts(posts: DataFrame, captions: DataFrame, name: str = "name", text: str = "text",
                 order: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """Apply every valid post to its caption, in post order (``order``:
    the columns that say it, e.g. file and ``post_no`` of S8).

    Returns ``(name, text, n_modified)`` for every caption.  Every post is
    applied, repeats too: a name that does not begin and end in a word
    character (``foo (artist)``) never counts as present, so its repeats
    change the caption again.  Each post depends on the text the earlier
    ones left, so the posts of one caption are folded in one row; that list
    is a limit of the input.
    """
    v = _valid(posts, order).where(_ok())
    v = v.select("filename", F.struct("at", F.lower("artist").alias("a"), F.lower("year").alias("y")).alias("p"))
    per_caption = v.groupBy("filename").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    none = F.array().cast(per_caption.schema["ps"].dataType)
    c = captions.select(F.col(name).alias("name"), F.col(text).alias("text"))
    j = c.join(per_caption, c.name == per_caption.filename, "left")

    def step(acc, p):
        new = tx.inject_artist_year(acc["t"], p["a"], p["y"])
        return F.struct(new.alias("t"), (acc["n"] + F.when(new != acc["t"], 1).otherwise(0)).alias("n"))

    init = F.struct(F.col("text").alias("t"), F.lit(0).alias("n"))
    j = j.select("name", F.aggregate(F.coalesce("ps", none), init, step).alias("f"))
    return j.select(F.col("name").alias(name), F.col("f.t").alias(text), F.col("f.n").cast("bigint").alias("n_modified"))


def inject_posts_summary(posts: DataFrame, captions: DataFrame, name: str = "name", text: str = "text",
                         order: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """J5 totals: modified, missing (valid post, no caption), skipped
    (artist, year or filename empty) -- one row."""
    v = _valid(posts, order)
    names = captions.select(F.col(name).alias("_n")).distinct()
    ok = v.where(_ok())
    missing = ok.join(names, ok.filename == names._n, "left_anti").select(F.lit("missing").alias("k"), F.lit(1).alias("v"))
    skipped = v.where(~_ok()).select(F.lit("skipped").alias("k"), F.lit(1).alias("v"))
    modified = inject_posts(posts, captions, name, text, order).select(F.lit("modified").alias("k"), F.col("n_modified").alias("v"))
    u = modified.unionByName(missing).unionByName(skipped)
    return u.agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).cast("bigint").alias(k)
                   for k in ("modified", "missing", "skipped")])
