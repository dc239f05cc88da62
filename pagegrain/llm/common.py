"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from pagegrain.session import shared_dir

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing before it."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and tab to carriage return, A-Z lower-cased; ``bytes.split`` cuts at exactly these six."""
    return text.translate(LOWER).split() if text else []


def in_slices(batches, rows: int = 256):
    """The rows of record batches as lists a column, a few rows at a time, so that few texts are Python objects at once. Freed memory returns to the system at the end."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield [c.to_pylist() for c in b.slice(i, rows).columns]
    trim()


def trim() -> None:
    """Give freed memory back: a worker that waits for its next task else keeps what the last one used."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class Hashes(dict):
    """word -> 64-bit hash, remembered for at most ``bound`` words."""

    def __init__(self, bound: int = 500_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def packed(a: np.ndarray, level: int = 3) -> bytes:
    """An array as compressed bytes, like bytes of its items side by side."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.size else b""
    return zstandard.compress(raw, level)


def unpacked(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel() if raw.size else np.zeros(0, dtype)


def sorted_packed(a: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as compressed differences."""
    return packed(np.diff(a, prepend=a.dtype.type(0)))


def sorted_unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.uint64), dtype=np.uint64)


def packed_words(ws: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, ws), np.uint32, len(ws))
    return zstandard.compress(np.uint32(len(ws)).tobytes() + lengths.tobytes() + b"".join(ws), 3)


def unpacked_words(b: bytes) -> list[bytes]:
    raw = zstandard.decompress(b)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[i:j] for i, j in zip([4 + 4 * n, *ends], ends)]


def per_batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
