"""Texts as blocks of token numbers with a dictionary per block.

A shuffle that moves every token of a corpus moves more than the corpus. Here a
task numbers the distinct words of about a million tokens; the shuffles that
look words up move each distinct word of a block once, packed by bucket, and the
answers return to the block, where the texts are put together again.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagegrain.llm.common import column, in_slices, packed, packed_words, trim, unpacked_words
from pagegrain.session import shared_dir

#: Tokens after which a block ends; a longer text is a block of its own.
BLOCK_TOKENS = 1 << 21


class Numbers(dict):
    """word -> its number, in order of first appearance."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


def buckets_for(docs: DataFrame, a_partition: int = 8) -> int:
    """Buckets in proportion to the input's partitions, so that a bucket stays as large as it is when the input grows."""
    return max(8, a_partition * docs.rdd.getNumPartitions())


def token_blocks(docs: DataFrame, key: str, text: str, cutter: Callable, flag: Column | None = None,
                 refine: Callable | None = None, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """block, keys, flags, ends, seq, words: every row of ``docs`` once, in blocks, in a table bucketed by block.

    ``cutter(bytes | None)`` gives the pieces of a text; ``refine(piece)`` cuts each
    distinct piece of a block into words. ``words`` holds the distinct words as bytes
    in order of appearance, ``seq`` their numbers, ``ends`` where each row ends in it. Equal keys, null keys and null or empty texts
    each stay a row. The table lies in the shared folder; grouping it by block needs
    no shuffle.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(to_arrow_type(kind))), ("flags", pa.list_(pa.bool_())),
                        ("ends", pa.binary()), ("seq", pa.binary()), ("words", pa.binary())])

    def build(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        numbers, keys, flags, seqs, size = Numbers(), [], [], [], 0

        def block():
            seq, ends = np.concatenate(seqs), np.cumsum([len(s) for s in seqs])
            ws = list(numbers)
            if refine is not None:
                fine, parts = Numbers(), [refine(w) for w in ws]
                lengths = np.array([len(p) for p in parts], np.int64)
                flat = np.fromiter((fine[w] for p in parts for w in p), np.int32)
                seq, to = spans(flat, np.cumsum(lengths) - lengths, lengths, seq)
                ends = np.concatenate(([0], to))[ends]
                ws = list(fine)
            row = (base + n, keys, flags, packed(ends.astype(np.int64)), packed(seq.astype(np.int32)), packed_words(ws))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for columns in in_slices(batches):
            for k, f, t in zip(*columns):
                pieces = cutter(t)
                keys.append(k)
                flags.append(f)
                seqs.append(np.fromiter(map(numbers.__getitem__, pieces), np.int32, len(pieces)))
                size += len(pieces)
                if size >= tokens:
                    yield block()
                    n, size, numbers, keys, flags, seqs = n + 1, 0, Numbers(), [], [], []
        if keys:
            yield block()
        trim()

    rows = docs.select(F.col(key), (flag if flag is not None else F.lit(True)).alias("__flag"), F.col(text).cast("binary").alias("__text"))
    made = rows.mapInArrow(build, f"block long, keys array<{kind.simpleString()}>, flags array<boolean>, ends binary, seq binary, words binary")
    name = f"blocks_{os.urandom(8).hex()}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(docs.rdd.getNumPartitions(), 50_000))
    made.write.option("compression", "zstd").option("path", shared_dir(spark, name)).bucketBy(n, "block").saveAsTable(name)
    return spark.table(name)


def spans(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[starts[i]:starts[i] + lengths[i]]`` of every i in ``at``, side by side, and where each of them ends."""
    take = lengths[at]
    to = np.cumsum(take)
    index = np.arange(to[-1] if to.size else 0)
    index += np.repeat(starts[at] - to + take, take)
    return flat[index], to


def by_bucket(ws: list[bytes], buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Numbers of the words in order of their bucket, and (bucket, start, end) of each bucket in this order."""
    to = np.fromiter(map(zlib.crc32, ws), np.int64, len(ws)) % buckets
    order = np.argsort(to, kind="stable")
    starts = np.flatnonzero(np.diff(to[order], prepend=-1))
    return order, [(int(to[order[i]]), int(i), int(j)) for i, j in zip(starts, [*starts[1:], len(ws)])]


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, words: the distinct words of a block that fall into a bucket, packed, in order of appearance."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary())])

    def deal(batches):
        for b in batches:
            for block, payload in zip(column(b, "block"), column(b, "words")):
                ws = unpacked_words(payload)
                order, cuts = by_bucket(ws, buckets)
                rows = [(k, block, packed_words([ws[i] for i in order[i:j].tolist()])) for k, i, j in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        trim()

    return blocks.select("block", "words").mapInArrow(deal, "bucket int, block long, words binary")
