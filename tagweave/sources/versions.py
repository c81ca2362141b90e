"""K4: caption sets in versions, never patched in place.

A version is a table under ``<root>/v<number>``.  It exists once its entry stands in ``<root>/_versions`` (a small file
moved into place after the table is written), so a version whose write failed is never read.  ``<root>/_versions/current``
names the current one; it is replaced in one step, and may be set back.  One job publishes to a root at a time."""

from __future__ import annotations

import datetime as dt
import json

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import open_path, put
from .sinks import write_version

SCHEMA = "name string, text string"


def _entries(root: str) -> tuple[pafs.FileSystem, str, dict[int, dt.datetime]]:
    """The published versions and when each was published (UTC)."""
    files, at = open_path(root)
    folder = f"{at}/_versions"
    files.create_dir(folder, recursive=True)
    out = {}
    for info in files.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with files.open_input_stream(info.path) as f:
                entry = json.loads(f.read())
            out[entry["version"]] = dt.datetime.fromisoformat(entry["published"])
    return files, folder, out


def versions(root: str) -> dict[int, dt.datetime]:
    return _entries(root)[2]


def current(root: str) -> int | None:
    files, folder, known = _entries(root)
    if files.get_file_info(f"{folder}/current").type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{folder}/current") as f:
        version = int(f.read())
    return version if version in known else None


def set_current(root: str, version: int) -> None:
    files, folder, known = _entries(root)
    if version not in known:
        raise ValueError(f"no version {version} in {root}")
    put(files, f"{folder}/current", str(version).encode())


def publish(df: DataFrame, root: str, when: dt.datetime | None = None, **kw) -> int:
    """Write ``df`` (name, text) as the next version and make it the current one; returns its number."""
    files, folder, known = _entries(root)
    version = max(known, default=0) + 1
    write_version(df, root, version, mode="overwrite", **kw)  # what a failed write of this number left goes
    published = (when or dt.datetime.now(dt.timezone.utc)).isoformat()
    put(files, f"{folder}/{version:04d}.json", json.dumps({"version": version, "published": published}).encode())
    set_current(root, version)
    return version


def read_version(spark: SparkSession, root: str, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """(name, text) of a version: the one named, the last one published by ``as_of``, or the current one."""
    known = versions(root)
    if version is None and as_of is not None:
        version = max((v for v, t in known.items() if t <= as_of), default=None)
    elif version is None:
        version = current(root)
    if version not in known:
        raise ValueError(f"no such version of {root}")
    return spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/v{version:04d}")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change, old_text, new_text) of the captions that differ: ``added``, ``removed`` or ``changed``; names are
    unique in a version, so one shuffle by name."""
    a = old.select("name", F.struct("text").alias("old"))
    b = new.select("name", F.struct("text").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    both = a.join(b, "name", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("name", change.alias("change"), F.col("old.text").alias("old_text"), F.col("new.text").alias("new_text"))
