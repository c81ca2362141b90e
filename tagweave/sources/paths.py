"""Files that tasks open themselves: one place that turns a path or URI into a file system."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

MIB = 1 << 20


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a plain path, a ``file:`` URI (as Spark writes them), or a URI of a store that
    pyarrow reads.  The place must be shared by all executors."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def put(files: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write a file so that readers see all of it or nothing: under another name first, then moved.  Writing the
    same file twice (a retried task) leaves one."""
    folder, name = os.path.split(path)
    part = f"{folder}/.{name[:100]}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def listed(files: pafs.FileSystem, folder: str, recursive: bool = False) -> Iterator[tuple[str, str, int]]:
    """(path, name, length) of a folder's files, one after the other: a local folder is never held whole; other
    stores give their listing at once."""
    if not isinstance(files, pafs.LocalFileSystem):
        for i in files.get_file_info(pafs.FileSelector(folder, recursive=recursive)):
            if i.type == pafs.FileType.File:
                yield i.path, i.base_name, i.size
        return
    folders = [folder.rstrip("/") or "/"]
    while folders:
        with os.scandir(folders.pop()) as entries:
            for e in entries:
                try:
                    size = e.stat().st_size if e.is_file() else None
                except FileNotFoundError:  # moved since it was listed
                    continue
                if size is not None:
                    yield e.path, e.name, size
                elif recursive and e.is_dir():
                    folders.append(e.path)


def list_files(spark: SparkSession, *folders: str, recursive: bool = False) -> DataFrame:
    """(path, file, length) of the files of folders, each listed by a task; hidden ones (``.`` or ``_`` first) are left
    out.  Unlike Spark's own file sources this shows files of no bytes."""
    def run(batches):
        for pdf in batches:
            for folder in pdf["folder"]:
                files, at = open_path(folder)
                scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else ""
                found = ((scheme + path, name, size) for path, name, size in listed(files, at, recursive) if name[0] not in "._")
                while part := list(islice(found, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "file", "length"])
    return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders))) \
        .mapInPandas(run, "path string, file string, length bigint")
