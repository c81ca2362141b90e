"""Readers for the files the original tool works on: caption folders,
image folders, dictionary / alias exports, label files and the model
registry.  Every reader declares its schema; none infers one."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..operators.files import DEDUP_IMAGE_EXTS, ext_of, stem_of
from .paths import list_files
from .records import read_records

REPLACEMENT_CHAR = "�"


def _file_name(path_col):
    return F.regexp_extract(path_col, r"([^/]*)$", 1)


def decode_captions(files: DataFrame, lenient: bool = False, file: str = "file", content: str = "content") -> DataFrame:
    """Caption bytes -> text.  Strict mode (S1) keeps only valid UTF-8 (the
    original skips a file it cannot decode); lenient mode (S2) drops the
    undecodable bytes instead."""
    raw = F.col(content).cast("string")
    if lenient:
        text = F.replace(F.make_valid_utf8(raw), F.lit(REPLACEMENT_CHAR), F.lit(""))
        out = files
    else:
        text = raw
        out = files.where(F.is_valid_utf8(raw))
    return out.select(F.col(file).alias("file"), stem_of(F.col(file)).alias("name"), text.alias("text"))


def read_captions(spark: SparkSession, folder: str, recursive: bool = False, lenient: bool = False) -> DataFrame:
    """Every ``.txt`` (suffix compared without case) of a folder ->
    ``(file, name, text)``, decoded by ``decode_captions``.  Reading through
    ``binaryFile`` keeps one row per file, and the glob keeps images out of
    the scan; captions of no bytes, which Spark's file sources leave out,
    come from a listing."""
    r = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]")
         .option("recursiveFileLookup", str(recursive).lower()).load(folder))
    r = r.select("content", _file_name(F.col("path")).alias("file"))
    blank = list_files(spark, folder, recursive=recursive).where("length = 0")
    r = r.unionByName(blank.select(F.lit(b"").alias("content"), "file"))
    return decode_captions(r.where(F.lower("file").endswith(".txt")), lenient)


def read_caption_sources(spark: SparkSession, folders: list[str]) -> DataFrame:
    """S3: several caption folders in order (a folder named twice counts
    once) -> ``(source, source_ord, file, name, text)``."""
    return stack_sources([(f, read_captions(spark, f)) for f in dict.fromkeys(folders)])


def stack_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """S3 for tables that are already read: named sources in order, one named
    again counting once."""
    out = None
    for i, (name, d) in enumerate(_first_of_each(sources)):
        d = d.select(F.lit(name).alias("source"), F.lit(i).alias("source_ord"), "file", "name", "text")
        out = d if out is None else out.unionByName(d)
    return out


def _first_of_each(sources: list[tuple[str, DataFrame]]) -> list[tuple[str, DataFrame]]:
    seen: dict[str, DataFrame] = {}
    for name, d in sources:
        seen.setdefault(name, d)
    return list(seen.items())


def read_images(spark: SparkSession, folder: str, exts=DEDUP_IMAGE_EXTS, with_content: bool = True) -> DataFrame:
    """Image files by extension (lower-cased suffix in ``exts``) ->
    ``(path, file, stem, ext, length, content)``.  Content is only read when
    asked for; ``length`` lets a caller route very large files elsewhere
    (``with_content=False`` first, then a read of the chosen ones)."""
    r = spark.read.format("binaryFile").load(folder)
    cols = ["path", "length"] + (["content"] if with_content else [])
    r = r.select(*cols).withColumn("file", _file_name(F.col("path")))
    r = r.where(F.lower(ext_of(F.col("file"))).isin(*exts))
    return r.withColumn("stem", stem_of(F.col("file"))).withColumn("ext", ext_of(F.col("file")))


def _header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV export, from its first line."""
    first = spark.read.text(path).first()
    return [c.strip().strip('"') for c in (first[0] if first else "").split(",")]


def _string_schema(names: list[str]) -> str:
    return ", ".join(f"`{n or f'c{i}'}` string" for i, n in enumerate(names))


_CSV_OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": ""}


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``(record_no, r)``: the records after the header, ``r`` a struct of text fields."""
    return read_records(spark, path).where("record_no > 0").select(
        "record_no", F.from_csv("record", _string_schema(names), _CSV_OPTIONS).alias("r"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Tag dictionary export -> ``(name, category int, post_count
    bigint)``; other columns are ignored.  The schema is declared from the
    header line, all text (``NA``/``null`` stay text); quoted line breaks
    belong to their field."""
    d = _rows(spark, path, _header_names(spark, path)).select("r.*")
    return d.select(F.col("name"), F.col("category").cast("int").alias("category"),
                    F.col("post_count").cast("bigint").alias("post_count"))


def read_alias_rows(spark: SparkSession, alias_path: str | None, implication_path: str | None) -> DataFrame:
    """Alias (``alias_name`` or ``antecedent_name``) and implication
    exports -> ``(antecedent_name, consequent_name, kind, row_no)``, kind 1
    for aliases and 2 for implications; ``row_no`` is the record's number in
    the file ("the last row wins")."""
    out = None
    for kind, path in ((1, alias_path), (2, implication_path)):
        if not path:
            continue
        names = _header_names(spark, path)
        ante = "alias_name" if "alias_name" in names else "antecedent_name"
        d = _rows(spark, path, names)
        d = d.select(F.col(f"r.{ante}").alias("antecedent_name"), F.col("r.consequent_name").alias("consequent_name"),
                     F.lit(kind).alias("kind"), F.col("record_no").cast("bigint").alias("row_no"))
        out = d if out is None else out.unionByName(d)
    return out


SNAPSHOT_DATE_RX = r"(\d{4}-\d{2}-\d{2})\.csv$"
# Fixed value: snapshots this many days old or more are stale.
MAX_LOOKBACK_DAYS = 90


def latest_snapshot(spark: SparkSession, folder: str, prefix: str, as_of: dt.date) -> tuple[str | None, bool]:
    """The newest ``<prefix>YYYY-MM-DD.csv`` of a folder and whether it
    is stale (``as_of`` minus its date is 90 days or more; a stale one is
    still used, as the original falls back to it).  Only file names are
    listed (no content is read); one path comes back to the driver."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.csv").load(folder)
               .select("path"))
    esc = re.escape(prefix)
    d = listing.select("path", F.to_date(F.regexp_extract(_file_name(F.col("path")), "^" + esc + SNAPSHOT_DATE_RX, 1),
                                         "yyyy-MM-dd").alias("d")).where(F.col("d").isNotNull())
    best = d.orderBy(F.col("d").desc()).select("path", "d").first()
    if best is None:
        return None, True
    age = (as_of - best["d"]).days
    return best["path"], age >= MAX_LOOKBACK_DAYS


def read_post_meta_files(spark: SparkSession, folder_or_file: str) -> DataFrame:
    """Post-metadata JSON files (one JSON object each) -> ``(file,
    post_no, post_key, artist, year, filename)``; ``(file, post_no)`` is the
    order in which ``inject_posts`` applies them."""
    from ..operators.posts import parse_post_meta
    t = spark.read.text(folder_or_file, wholetext=True).select(
        _file_name(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))
    return parse_post_meta(t, keep=("file",))


def read_label_file(spark: SparkSession, path: str, model: str, column: int = 0,
                    skip_first_line: bool = False) -> DataFrame:
    """A model's label vocabulary -> ``(model, idx, tag)`` with ``_``
    read as a space.

    JSON object ``{tag: index}`` (of a repeated index the last tag in file
    order counts; indices without a tag get ``""``), JSON list (position is
    the index), or CSV: the label column is ``column``; the first line is
    skipped when asked, or when it names a ``name``/``tag``/``tags`` column
    (that column is then used, if ``column`` is 0); otherwise the first line
    is a label too.  CSV labels are stripped; rows too short for the label
    column are skipped, and later labels move up."""
    lower = path.lower()
    blank = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    if lower.endswith(".json"):
        t = spark.read.text(path, wholetext=True)
        j = t.select(F.from_json("value", "map<string,int>").alias("m"), F.from_json("value", "array<string>").alias("l"))
        rows_obj = j.where(F.col("m").isNotNull()).select(F.posexplode(F.map_entries("m")).alias("pos", "e"))
        rows_obj = rows_obj.groupBy(F.col("e.value").alias("idx")).agg(F.max_by("e.key", "pos").alias("tag"))
        size = rows_obj.agg(F.max("idx").alias("mx"))
        dense = size.select(F.explode(F.sequence(F.lit(0), F.col("mx"))).alias("idx")).join(rows_obj, "idx", "left")
        dense = dense.select("idx", F.coalesce(blank(F.col("tag")), F.lit("")).alias("tag"))
        rows_lst = j.where(F.col("m").isNull() & F.col("l").isNotNull()).select(F.posexplode("l").alias("idx", "tag"))
        out = dense.unionByName(rows_lst.select("idx", blank(F.col("tag")).alias("tag")))
    elif lower.endswith(".csv"):
        names = [n.lower() for n in _header_names(spark, path)]
        use, skip = column, skip_first_line
        if not skip and column == 0 and any(n in {"name", "tag", "tags"} for n in names):
            use, skip = next(i for i, n in enumerate(names) if n in {"name", "tag", "tags"}), True
        width = max(use + 1, len(names))
        lines = read_records(spark, path)
        if skip:
            lines = lines.where("record_no > 0")
        row = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), _CSV_OPTIONS)
        labels = lines.select("record_no", row[f"c{use}"].alias("label")).where(F.col("label").isNotNull())
        # one row of labels in file order: their positions are the indices
        whole = labels.agg(F.sort_array(F.collect_list(F.struct("record_no", "label"))).alias("ls"))
        out = whole.select(F.posexplode("ls").alias("idx", "x")).select("idx", blank(strip_ws(F.col("x.label"))).alias("tag"))
    else:
        raise ValueError(f"unknown tag file type: {path}")
    return out.select(F.lit(model).alias("model"), F.col("idx").cast("int").alias("idx"), "tag")


REGISTRY_STRUCT = ("struct<repo:string,subfolder:string,filename:string,timm_id:string,num_classes:int,"
                   "tags_file:string,head_type:string,supports_cam:boolean,backend:string,"
                   "use_column_number:int,skip_first_line:boolean>")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Model registry JSON -> one row per model with defaults for the
    optional fields (``backend`` pytorch, ``supports_cam`` true, CSV column
    0, no header skip)."""
    t = spark.read.text(path, wholetext=True)
    m = t.select(F.explode(F.from_json("value", f"map<string,{REGISTRY_STRUCT}>")).alias("model", "s"))
    return m.select("model", "s.repo", "s.subfolder", "s.filename", "s.num_classes", "s.tags_file", "s.head_type",
                    F.coalesce("s.supports_cam", F.lit(True)).alias("supports_cam"),
                    F.coalesce("s.backend", F.lit("pytorch")).alias("backend"),
                    F.coalesce("s.use_column_number", F.lit(0)).alias("use_column_number"),
                    F.coalesce("s.skip_first_line", F.lit(False)).alias("skip_first_line"))


def capable_models(registry: DataFrame) -> DataFrame:
    """Models whose ``supports_cam`` is not false (default true)."""
    return registry.where(F.coalesce(F.col("supports_cam"), F.lit(True)))
