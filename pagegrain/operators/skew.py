"""Ordered operators for keys that may hold a large part of all rows.

A plain window gathers a whole key on one task. These helpers cut every key
into buckets of its ordering value, work inside buckets, and carry one summary
row per bucket across them. The bucket is a function of the row alone, so a
retried task gets the same answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, bucket: Column, name: str = "running",
                  inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` by ``order`` within ``keys``; ``bucket`` must grow with ``order``."""
    rows = df.withColumns({"_b": bucket, "_v": value})
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carried"))
    stop = 0 if inclusive else -1
    inside = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, stop)
    # Null keys and buckets are groups of their own.
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_b").eqNullSafe(F.col("_kb")))
    return rows.join(base, on).withColumn(
        name, F.col("_carried") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_b", "_v", "_carried", "_kb", *[f"_k{i}" for i in range(len(keys))])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: Column, bucket, name: str = "found", tie: Column | None = None) -> DataFrame:
    """Last ``value`` of ``right`` at or before each ``on`` of ``left`` within ``keys``; null before the first.

    ``bucket`` maps the ordering column to a bucket that grows with it. Of rows of
    ``right`` at one position the one with the largest ``tie`` is the last, without
    it the one with the largest value.
    """
    l = left.withColumns({"_side": F.lit(1), "_val": F.lit(None), "_tie": F.lit(None)})
    r = right.select(*keys, F.col(on), value.alias("_val"), F.lit(0).alias("_side"), (value if tie is None else tie).alias("_tie"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_b", bucket(F.col(on)))
    tails = r.withColumn("_b", bucket(F.col(on))).groupBy(*keys, "_b").agg(F.max_by("_val", F.struct(on, "_tie")).alias("_last"))
    # Buckets a key has rows in, on either side, with the last value of any earlier one.
    marks = both.select(*keys, "_b").distinct().join(tails, [*keys, "_b"], "left")
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = marks.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(*keys, "_b").orderBy(on, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    seen = both.join(carry, [*keys, "_b"]).withColumn(name, F.coalesce(F.last("_val", ignorenulls=True).over(inside), F.col("_carry")))
    return seen.where(F.col("_side") == 1).select(*left.columns, name)


def latest_by(df: DataFrame, keys: list[str], order: list[str], first: str | None = None) -> DataFrame:
    """The last row of every key by ``order``, as a partial aggregate.

    ``first`` names a column whose smallest value over the key is kept, such as
    the list position a replaced record stays at.
    """
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")]
    if first:
        aggs.append(F.min(first).alias("_first"))
    out = df.groupBy(*keys).agg(*aggs)
    cols = [F.col("_r." + c).alias(c) for c in rest if c != first]
    return out.select(*keys, *cols, *([F.col("_first").alias(first)] if first else []))


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key by ``order``.

    The rank filter is applied on every task before the shuffle, so a hot key
    sends at most ``n`` rows per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
