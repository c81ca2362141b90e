"""Sinks: caption tables per stage (K1, K3), per-model outputs (K2), new
versions instead of in-place edits (K4), and a plain-text export."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws


def write_captions(df: DataFrame, path: str, name: str = "name", text: str = "text", strip: bool = False,
                   mode: str = "errorifexists") -> None:
    """K1 (+K3 with ``strip``): one caption per name as a Parquet table.
    The default refuses to overwrite: a patched caption set is written as a
    new version (K4) next to the old one."""
    t = strip_ws(F.col(text)) if strip else F.col(text)
    df.select(F.col(name).alias("name"), t.alias("text")).write.mode(mode).parquet(path)


def write_version(df: DataFrame, root: str, version: int, **kw) -> str:
    """K4: write ``df`` as version ``v<version>`` under ``root``; returns the
    path."""
    path = os.path.join(root, f"v{version:04d}")
    write_captions(df, path, **kw)
    return path


def write_by_model(df: DataFrame, path: str, key: str = "model", mode: str = "errorifexists") -> None:
    """K2: per-model outputs, one partition folder per full model id (two
    vendors with the same last id part stay apart; Spark escapes the
    slash)."""
    df.write.mode(mode).partitionBy(key).parquet(path)


def export_caption_text(df: DataFrame, folder: str, name: str = "name", text: str = "text",
                        mode: str = "errorifexists") -> None:
    """K1/G5 for tools that read text: the stripped captions as plain text
    under ``folder/name=<name>/``, written by Spark's own committer to a
    shared path (no size limit, and a lost executor leaves no half file)."""
    rows = df.select(F.col(name).alias("name"), strip_ws(F.col(text)).alias("value"))
    rows.repartition("name").sortWithinPartitions("name").write.mode(mode).partitionBy("name").text(folder)
