"""Uploaded files as a data source: every file of a folder, empty ones too, with its size and first bytes.

The file sources of Spark leave out files without bytes and read a file's whole
content. This source lists the folder once, hands slices of the list to tasks, and a task
reads as many leading bytes as asked for. Files are opened through pyarrow, which must
know the scheme of the folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, content binary"
#: Bytes read of a file, and files of a task.
HEAD, FILES = 8, 2000


def filesystem(folder: str):
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder)) if re.match(r"\w+:", folder) else (pyarrow.fs.LocalFileSystem(), folder)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class UploadReader(DataSourceReader):
    def __init__(self, folder: str, head: int, files: int):
        self.folder, self.head, self.files = folder, head, files

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.folder)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file and not re.match(r"[._]", f.base_name))
        return [Files(found[i:i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.folder)
        rows = []
        for path, size in partition.files:
            with fs.open_input_stream(path, compression=None) as f:
                rows.append((path, size, f.read(self.head)))
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], names=["path", "length", "content"])


class UploadSource(DataSource):
    """``spark.read.format("uploads").load(folder)``; options ``head`` (bytes) and ``files`` (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return UploadReader(self.options["path"], int(self.options.get("head", HEAD)), int(self.options.get("files", FILES)))


def listed(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    """(path, length, content), content being the first bytes, of every file below ``folder``; hidden files are left out."""
    spark.dataSource.register(UploadSource)
    return spark.read.format("uploads").options(**options).load(folder)


def _saved(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns)):
                # Written aside and then moved, so that a repeated task leaves one whole file.
                aside = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(aside, compression=None) as f:
                    f.write(content or b"")
                fs.move(aside, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
    return run


def save(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write a file a row, of exactly these bytes, null as none; returns how many."""
    counted = files.select(name, content).mapInArrow(_saved(folder), "n long")
    return counted.agg({"n": "sum"}).first()[0] or 0
