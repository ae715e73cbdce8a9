"""A folder of files as a data source that also sees names that begin with '_' or '.'.

Spark's file readers leave such names out at every level. This source lists a folder itself: the driver goes down level by level
until there are SPLITS folders, and tasks list what is below. A folder's own files are handed out in groups.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLITS = 256  # folders that the driver opens before it hands them out
FILES = 1000  # files of a group
BATCH_BYTES = 4 << 20
_NAME = "markdown_folder"
_SCHEMA = "path string, length bigint, modified timestamp, text string"


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it. Raises ``pa.ArrowInvalid`` for a store that is not known."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.abspath(root)
    return fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))


def is_known(root: str) -> bool:
    """Whether :func:`read_folder` can open ``root``."""
    try:
        store_of(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


@dataclass
class Below(InputPartition):
    """All files below a folder."""

    folder: str


@dataclass
class Files(InputPartition):
    """Some files."""

    paths: list[str]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob, self.splits = options["path"], options.get("glob", "*"), int(options.get("splits", SPLITS))
        self.content = str(options.get("content", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        store, top = store_of(self.root)
        files, folders = [], [top]
        while folders and len(folders) < self.splits:
            below = []
            for folder in folders:
                for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=folder == top)):
                    if info.type == fs.FileType.Directory:
                        below.append(info.path)
                    elif info.is_file and fnmatchcase(info.base_name, self.glob):
                        files.append(info.path)
            folders = below
        groups = [Files(files[k : k + FILES]) for k in range(0, len(files), FILES)]
        return [*groups, *(Below(f) for f in folders)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, top = store_of(self.root)
        if isinstance(partition, Files):
            found = store.get_file_info(partition.paths)
        else:
            found = store.get_file_info(fs.FileSelector(partition.folder, recursive=True))
        rows, size = [], 0
        for info in found:
            if not info.is_file or not fnmatchcase(info.base_name, self.glob):
                continue
            text = None
            if self.content:
                with store.open_input_stream(info.path) as stream:
                    text = stream.read().decode(errors="replace")
            rows.append((posixpath.relpath(info.path, top), info.size, info.mtime.astimezone(UTC), text))
            size += len(text or "") + 100
            if size > BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string()]
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "length", "modified", "text"])


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return _NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def read_folder(spark: SparkSession, root: str, glob: str = "*", content: bool = True, splits: int = SPLITS) -> DataFrame:
    """(path, length, modified, text) of every file below ``root`` whose name matches; ``text`` is null without ``content``."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(_NAME).option("glob", glob).option("content", str(content).lower()).option("splits", str(splits)).load(root)
