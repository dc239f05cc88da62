"""Sharding along a Hilbert curve: rows near in several metadata dimensions share a shard.

Every dimension is cut into ``1 << bits`` levels over all rows: numbers at their
quantiles, text and binary by the place of the whole value among all values, each
weighted by its rows; nulls lie in the lowest level. The levels are the
coordinates of a cell; rows are sorted by the index of their cell on the Hilbert
curve, then by the tie columns, and runs of the order are cut into shards whose
row counts differ by one at most. Files written from a shard therefore span
small ranges of every dimension, which readers prune by.

Positions come from a range partitioning: rows are counted by partition, and only
one number a partition reaches the driver. Rows equal in everything stay apart
rows. An empty table gives an empty result; fewer rows than shards leave shards
empty. Columns that are asked for are carried, results replace a column of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagegrain.llm.common import cut
from pagegrain.operators import skew

BITS = 5


def hilbert(levels: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index on the curve of cells given by one array of levels a dimension."""
    x = [np.array(v, np.int64) for v in levels]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            up = (x[i] >> bit & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] ^ flip) >> bit & 1
    return index


def value_level(df: DataFrame, name: str, bits: int) -> Column:
    """The level of a text by its place in the order of whole values: how many rows lie below the middle of its own.

    Distinct values are counted and ordered on Spark; the smallest value of each
    level, ``1 << bits`` at most, is all that reaches the driver.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__value")).agg(F.count("*").alias("__n"))
    ordered = cut(counts.repartitionByRange("__value").select("__value", "__n", F.spark_partition_id().alias("__part")), "shard-values")
    total = ordered.agg(F.sum("__n")).first()[0] or 1
    below = skew.running_total(ordered, [], "__value", F.col("__n"), F.col("__part"), "__upto")
    level = F.expr(f"(2 * __upto - __n) * {1 << bits} div {2 * total}")
    starts = below.groupBy(level.alias("level")).agg(F.min("__value").alias("start")).collect()
    out = F.lit(0)
    for r in sorted(starts, key=lambda r: r["level"]):
        out = F.when(F.col(name) >= F.lit(r["start"]), r["level"]).otherwise(out)
    return out.cast("bigint")


def levels(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """The level of each dimension over all rows: of a number, how many of its quantiles lie below."""
    texts = [d for d in dims if isinstance(df.schema[d].dataType, (T.StringType, T.BinaryType))]
    numbers = [d for d in dims if d not in texts]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    number = lambda d: F.col(d).cast("double")
    found = df.agg(*(F.percentile_approx(number(d), shares, 10_000).alias(f"q{i}") for i, d in enumerate(numbers))).first() if numbers else ()
    level = {d: value_level(df, d, bits) for d in texts}
    for d, cuts in zip(numbers, found):
        level[d] = F.coalesce(sum((F.when(number(d) > c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0)), F.lit(0)).cast("bigint")
    return [level[d] for d in dims]


def assign(df: DataFrame, dims: list[str], ties: list[str], shards: int, carry: list[str], bits: int = BITS) -> DataFrame:
    """``carry`` columns with curve, shard and slot (place in the shard, from 0)."""

    @F.arrow_udf("bigint")
    def curve(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array(hilbert([v.to_numpy(zero_copy_only=False) for v in (c if isinstance(c, tuple) else (c,))], bits))

    kept = [*dict.fromkeys([*carry, *ties])]
    numbered = df.select(*kept, *(v.alias(f"__level{i}") for i, v in enumerate(levels(df, dims, bits))))
    rows = numbered.select(*kept, curve(*(F.col(f"__level{i}") for i in range(len(dims)))).alias("__curve"))
    ordered = rows.repartitionByRange("__curve", *ties).sortWithinPartitions("__curve", *ties)
    schema = T.StructType([*ordered.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__index", T.LongType())])
    arrow = to_arrow_schema(schema)

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            extra = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, *extra], arrow)], schema=arrow)

    placed = cut(ordered.mapInArrow(number, schema), "shard-order")
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, n = [], 0
    for part, size in sizes:
        starts.append((part, n))
        n += size
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    at = F.col("__start") + F.col("__index")
    shard = F.expr(f"(__start + __index) * {shards} div {max(n, 1)}")
    first = F.expr(f"((__start + __index) * {shards} div {max(n, 1)} * {max(n, 1)} + {shards - 1}) div {shards}")
    return placed.join(F.broadcast(offsets), "__part").select(*carry, F.col("__curve").alias("curve"), shard.cast("int").alias("shard"), (at - first).alias("slot"))


def write(df: DataFrame, dims: list[str], ties: list[str], shards: int, path: str, rows_a_file: int = 1_000_000) -> None:
    """All columns of ``df`` as files by shard, in curve order inside each file."""
    placed = assign(df, dims, ties, shards, df.columns)
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path))
