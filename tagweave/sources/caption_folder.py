"""A caption folder as a Spark data source, one ``<name>.txt`` per caption.

    spark.dataSource.register(CaptionFolder)
    df.write.format("caption_folder").mode("append").save(folder)      # (name, text)
    spark.read.format("caption_folder").load(folder)                   # (file, name, text)

Writing: every task writes its own captions, each under another name that is then moved, so a reader never sees
half a caption and a retried task leaves one file.  Nothing is listed or moved on the driver: commit adds
``_SUCCESS``, abort takes back the files whose names the tasks reported, unless they were there before.
Overwrite removes earlier captions of the folder first (only files ending in .txt).

Reading: ``partitions`` tasks each list the folder and take the names of their own hash bucket; the driver lists
nothing.  Text that is not UTF-8 is left out, as S1 does, or stripped of the bad bytes with ``lenient``.

Options: ``partitions`` (reading, default 16), ``strip`` (writing, K3: surrounding white space goes, default true),
``lenient`` (reading, S2).  The folder must be shared by all executors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import WHITE_SPACE
from .paths import listed, open_path, put

_EDGES = "".join(WHITE_SPACE)


def _true(options: dict, key: str, default: str) -> bool:
    return str(options.get(key, default)).lower() == "true"


class CaptionFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "caption_folder"

    def schema(self) -> str:
        return "file string, name string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        names = schema.fieldNames()
        if "name" not in names or "text" not in names:
            raise ValueError("a caption folder is written from the columns name and text")
        return _Writer(self.options, names.index("name"), names.index("text"), overwrite)


@dataclass
class _Bucket(InputPartition):
    at: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.count = int(options.get("partitions", 16))
        self.lenient = _true(options, "lenient", "false")

    def partitions(self) -> list[_Bucket]:
        return [_Bucket(i) for i in range(self.count)]

    def read(self, partition: _Bucket) -> Iterator[tuple]:
        files, folder = open_path(self.folder)
        for path, name, _ in listed(files, folder):
            if not name.lower().endswith(".txt") or name.startswith(".") \
                    or zlib.crc32(name.encode()) % self.count != partition.at:
                continue
            with files.open_input_stream(path) as f:
                data = f.read()
            try:
                yield name, name[:-4], data.decode("utf-8", "ignore" if self.lenient else "strict")
            except UnicodeDecodeError:
                continue


@dataclass
class _Written(WriterCommitMessage):
    fresh: list[str] = field(default_factory=list)
    count: int = 0


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, name_at: int, text_at: int, overwrite: bool):
        self.folder, self.name_at, self.text_at = options["path"], name_at, text_at
        self.strip = _true(options, "strip", "true")
        files, folder = open_path(self.folder)
        files.create_dir(folder, recursive=True)
        if overwrite:
            for info in files.get_file_info(pafs.FileSelector(folder)):
                if info.type == pafs.FileType.File and info.base_name.lower().endswith(".txt"):
                    files.delete_file(info.path)

    def write(self, iterator) -> _Written:
        files, folder = open_path(self.folder)
        out = _Written()
        for row in iterator:
            name, text = row[self.name_at], row[self.text_at]
            if name is None or text is None:
                continue
            if "/" in name or name in ("", ".", "..") or name.startswith("."):
                raise ValueError(f"not a caption's name: {name!r}")
            path = f"{folder}/{name}.txt"
            if files.get_file_info(path).type == pafs.FileType.NotFound:
                out.fresh.append(path)
            put(files, path, (text.strip(_EDGES) if self.strip else text).encode())
            out.count += 1
        return out

    def commit(self, messages: list) -> None:
        files, folder = open_path(self.folder)
        put(files, f"{folder}/_SUCCESS", b"")

    def abort(self, messages: list) -> None:
        files, _ = open_path(self.folder)
        for m in messages:
            for path in m.fresh if m is not None else ():
                if files.get_file_info(path).type == pafs.FileType.File:
                    files.delete_file(path)
