"""Connected components of links by alternating stars.

Every round hangs the larger neighbours of a node on the smallest node among it
and its neighbours, then the smaller ones; the edges become stars around the
smallest node of each component in a number of rounds that grows with the
logarithm of the longest chain. A minimum is combined on every task before the
shuffle and joined back, so that the edges of a hub can be split over tasks. Every
task first drops the links that close a circle among its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import cut, in_slices


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (u, v) with u > v, each once, before and after."""
    if larger:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def forest(edges: DataFrame) -> DataFrame:
    """On every task, the edges (u, v) that join what its earlier ones have not joined yet."""

    def grow(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        for us, vs in in_slices(batches, 10_000):
            out = []
            for u, v in zip(us, vs):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["u", "v"])

    return edges.mapInArrow(grow, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: every node with a link and the smallest node it reaches. Null ends and links of a node with itself count for nothing."""
    given = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = forest(given.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    edges, before = cut(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        edges = cut(_star(_star(edges, True), False), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
