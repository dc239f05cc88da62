"""Small files by the million: one file a row, dealt over a fixed number of folders.

Spark's own writer opens a folder a key and its readers list every file on the
driver. Here tasks write each file through pyarrow into the folder that its name's
hash gives, and a task of the reader lists and reads folders of its own, so the driver
knows the folders alone. Files hold exactly the bytes given. Pyarrow must know the
scheme of the folder.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.sources.uploads import filesystem

#: Folders, folders of a reading task, and the bytes and files after which a batch is handed on.
FOLDERS, OF_TASK, BATCH_BYTES, BATCH_FILES = 1024, 16, 16 << 20, 2000


def folder_of(name: str) -> str:
    return f"{zlib.crc32(name.encode()) % FOLDERS:04d}"


def _saved(root_uri: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(root_uri)
        made = set()
        for b in batches:
            for name, content in zip(*b.columns):
                name, content = name.as_py(), content.as_py()
                folder = f"{root}/{folder_of(name)}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                # Written aside and then moved, so that a repeated task leaves one whole file.
                aside = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(aside, compression=None) as f:
                    f.write(content or b"")
                fs.move(aside, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
    return run


def save(rows: DataFrame, root: str, name: str = "name", text: str = "value") -> int:
    """Write a file a row, null as none; names must be unique. Returns how many."""
    counted = rows.select(F.col(name).cast("string"), F.encode(F.col(text), "UTF-8")).mapInArrow(_saved(root), "n long")
    return counted.agg({"n": "sum"}).first()[0] or 0


def _read(root_uri: str):
    def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        names, contents = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(root_uri)
        rows, size = [], 0
        for number in (n.as_py() for b in batches for n in b.column(0)):
            selector = pyarrow.fs.FileSelector(f"{root}/{number:04d}", allow_not_found=True)
            for info in fs.get_file_info(selector):
                if not info.is_file or re.match(r"[._]", info.base_name):
                    continue
                with fs.open_input_stream(info.path, compression=None) as f:
                    rows.append((info.base_name, f.read()))
                size += info.size
                if size >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)
    return run


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(name, value) of every file that ``save`` left below ``root``, empty files too; the order of rows is left open."""
    folders = spark.range(0, FOLDERS, 1, FOLDERS // OF_TASK)
    return folders.mapInArrow(_read(root), "name string, content binary").select("name", F.col("content").cast("string").alias("value"))
