"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree.

Vectors get one more component, so that all have the length of the longest and
the nearest of a query (whose new component is zero) is the one of largest inner
product. A tree is fitted on at most about ``FIT_ROWS`` of them, chosen by a hash;
its leaves hold about ``LEAF_ROWS`` vectors, but there are at most
``FIT_ROWS // 16`` leaves, which bounds what is sent to the tasks. Every vector is
filed in its leaf.

A query walks the tree best bin first: a queue holds the branches not taken,
nearest centre on top, until enough leaves are visited. How many are enough is
calibrated: the exact neighbours of ``CALIBRATE`` queries are found by brute
force, and visits widen until the leaves hold at least ``RECALL`` of them. Queries
that have equal vectors find those in their first leaf; they are calibrated apart
from the others, and the wider of both counts. Visits also go on until the leaves
hold ``k`` vectors besides the query's own.

Leaves are packed into bins of about ``BIN_ROWS`` vectors; a larger leaf is dealt
over bins of its own. A query comes to a bin once, with the leaves it visits
there, and leaves with its best of them; the queries of a bin are dealt over
``BIN_QUERIES`` at a time, so no task gets a whole hot leaf. Equal vectors are
scored once; ranking is by the exact score, ties by the smaller id.

Vectors that are null, empty, all zero, hold a null or a non-finite component, or
have another length than most, take no part. Ids are distinct numbers; rows that
repeat an id and vector count once, and a null id takes no part. With fewer
candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrain.llm.common import cut, trim

FIT_ROWS = 1 << 16
LEAF_ROWS = 256
BRANCHES = 16
CALIBRATE = 128
RECALL = 0.97
BIN_ROWS = 8_192
BIN_QUERIES = 4_096


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v array<double> of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size("v") == (sizes["size"] if sizes else 0))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the centre of every row; centres that lose all rows vanish."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        centres = np.unique(centres, axis=0)
        of = nearest_centre(x, centres)
        used, of = np.unique(of, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, of, x)
        centres = sums / np.bincount(of)[:, None]
    return centres, nearest_centre(x, centres)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T * -2 + (centres**2).sum(1)).argmin(1)


def grow(x: np.ndarray, leaves: int, seed: int = 7) -> list[tuple[np.ndarray, list[int]]]:
    """The tree as nodes (centres of the children, nodes of the children or -1 - leaf); node 0 is the root."""
    rng, nodes, count = np.random.default_rng(seed), [], 0
    limit = max(1, len(x) // max(1, leaves))
    waiting = [(x, None)]
    while waiting:
        rows, hang = waiting.pop()
        k = min(BRANCHES, -(-len(rows) // limit))
        centres, of = kmeans(rows, k, rng) if k > 1 else (None, None)
        if centres is None or len(centres) < 2:
            mine, count = -1 - count, count + 1
            if hang is None:
                nodes.append((rows[:1], [mine]))
        else:
            mine = len(nodes)
            nodes.append((centres, [0] * len(centres)))
            waiting += [(rows[of == i], (mine, i)) for i in range(len(centres))]
        if hang is not None:
            nodes[hang[0]][1][hang[1]] = mine
    return nodes


def leaf_of(x: np.ndarray, nodes) -> np.ndarray:
    """The leaf every row is filed in: the nearest child at each node."""
    out, waiting = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while waiting:
        node, rows = waiting.pop()
        centres, children = nodes[node]
        of = nearest_centre(x[rows], centres)
        for i in np.unique(of).tolist():
            if children[i] < 0:
                out[rows[of == i]] = -1 - children[i]
            else:
                waiting.append((children[i], rows[of == i]))
    return out


def visits(q: np.ndarray, nodes):
    """Leaves best bin first: the nearest open branch of the whole tree comes next."""
    queue, n = [(0.0, 0, 0)], 1
    while queue:
        _, _, node = heapq.heappop(queue)
        if node < 0:
            yield -1 - node
            continue
        centres, children = nodes[node]
        for d, child in zip(((centres - q) ** 2).sum(1).tolist(), children):
            heapq.heappush(queue, (d, n, child))
            n += 1


def matrix(a: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))[:, None]], 1)


def best(ids: np.ndarray, x: np.ndarray, queries: list[tuple[int, np.ndarray]], k: int, of_leaf: np.ndarray | None = None, visited: list | None = None) -> list[tuple[int, int, float]]:
    """(query, id, score) of the k best rows of every query but its own, in its ``visited`` leaves where given; equal rows are scored once."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, first, of = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    distinct = x[first]
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
    leaf = of_leaf[order][first] if of_leaf is not None else None
    out = []
    rough = distinct @ np.array([q for _, q in queries]).T
    for j, (query, q) in enumerate(queries):
        r = rough[:, j]
        if visited is not None:
            r = np.where(np.isin(leaf, visited[j]), r, -np.inf)
        n = min(len(r), k + 1)
        least = np.partition(r, len(r) - n)[len(r) - n]
        near = np.flatnonzero((r >= least - 1e-9 * (1 + abs(least))) & (r > -np.inf)) if np.isfinite(least) else np.flatnonzero(r > -np.inf)
        exact = (distinct[near] * q).sum(1)
        rows = [(-s, int(i)) for s, m in zip(exact.tolist(), near.tolist()) for i in dict.fromkeys(ids[members[m][:2 * k + 2]].tolist()) if i != query]
        out += [(query, i, -s) for s, i in heapq.nsmallest(k, rows)]
    return out


def bins(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """leaf -> its first bin and how many it has: small leaves share one."""
    out, bin_, held = {}, 0, 0
    for leaf, n in sorted(sizes.items()):
        parts = -(-n // BIN_ROWS)
        if held and held + n > BIN_ROWS:
            bin_, held = bin_ + 1, 0
        out[leaf] = (bin_, parts)
        held += n
        if parts > 1:
            bin_, held = bin_ + parts, 0
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for every row of ``vectors`` where ``is_query``, a condition on the column ``id``, holds, among all the other rows."""
    spark = vectors.sparkSession
    rows = valid(vectors, key, vector)
    totals = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    n, longest = totals["n"], float(np.sqrt(totals["longest"] or 0.0))
    share = min(1.0, FIT_ROWS / max(n, 1))
    sample = rows.where(F.abs(F.xxhash64("id")) <= share * float(2**63 - 1)).select("v").toArrow().column("v").combine_chunks()
    result = "query_id long, vec_id long, score double"
    if len(sample) == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nodes = grow(lifted(matrix(sample), longest), min(-(-n // LEAF_ROWS), FIT_ROWS // 16))
    tree = spark.sparkContext.broadcast((nodes, longest))

    def file(batches):
        t, top = tree.value
        for b in batches:
            leaf = leaf_of(lifted(matrix(b.column(1)), top), t) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], ["leaf", "id", "v"])
        trim()

    index = cut(rows.mapInArrow(file, "leaf long, id long, v array<double>"), "leaves")
    asked = index.where(is_query).dropDuplicates(["id"])
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    enough = calibrated(index, asked, nodes, longest, k, recall)

    def walk(q: np.ndarray, sizes: dict[int, int], t, top: float) -> list[int]:
        out, held = [], 0
        for leaf in visits(np.append(q, 0.0), t):
            if len(out) >= enough and held > k:
                break
            if leaf in sizes:
                out.append(leaf)
                held += sizes[leaf]
        return out

    place = bins(sizes)

    def ask(batches):
        """A row for each bin that a query comes to, with the leaves it visits there."""
        t, top = tree.value
        for b in batches:
            at, to, leaves = [], [], []
            for i, q in enumerate(matrix(b.column(1))):
                by: dict[int, list[int]] = {}
                for leaf in walk(q, sizes, t, top):
                    first, parts = place[leaf]
                    for bin_ in range(first, first + parts):
                        by.setdefault(bin_, []).append(leaf)
                at += [i] * len(by)
                to += by
                leaves += by.values()
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(leaves, pa.list_(pa.int64()))], ["bin", "id", "v", "leaves"])
        trim()

    walks = cut(asked.select("id", "v").mapInArrow(ask, "bin long, id long, v array<double>, leaves array<long>"), "walks")
    shape = spark.createDataFrame([(r["bin"], -(-r["n"] // BIN_QUERIES)) for r in walks.groupBy("bin").agg(F.count("*").alias("n")).collect()], "bin long, rows int")
    places = spark.createDataFrame([(leaf, *p) for leaf, p in place.items()], "leaf long, first long, parts int")
    dealt = F.xxhash64("id")
    filed = index.join(F.broadcast(places), "leaf").withColumn("bin", F.col("first") + F.pmod(dealt, F.col("parts")))
    filed = filed.join(F.broadcast(shape), "bin").select("bin", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "leaf", "id", "v")
    asking = walks.join(F.broadcast(shape), "bin").select("bin", F.pmod(dealt, F.col("rows")).cast("int").alias("row"), "id", "v", "leaves")

    def meet(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, leaf, x = left.column("id").to_numpy(), left.column("leaf").to_numpy(), matrix(left.column("v").combine_chunks())
            qs, visited = list(zip(right.column("id").to_pylist(), matrix(right.column("v").combine_chunks()))), right.column("leaves").to_pylist()
            for i in range(0, len(qs), 128):
                found += best(ids, x, qs[i:i + 128], k, leaf, visited[i:i + 128])
        trim()
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["query_id", "vec_id", "score"])

    where = ["bin", "row"]
    met = filed.groupBy(*where).cogroup(asking.groupBy(*where)).applyInArrow(meet, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score, leaf: the k best of every query by brute force; the queries, a bounded number, go to every task."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def scan(batches):
        for b in batches:
            if b.num_rows:
                ids = b.column(1).to_numpy()
                found = best(ids, matrix(b.column(2)), shared.value, k)
                leaf = dict(zip(ids.tolist(), b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()),
                                                  pa.array([leaf[f[1]] for f in found], pa.int64())], ["query_id", "vec_id", "score", "leaf"])
        trim()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    met = rows.select("leaf", "id", "v").mapInArrow(scan, "query_id long, vec_id long, score double, leaf long")
    return met.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated(index: DataFrame, asked: DataFrame, nodes, longest: float, k: int, recall: float) -> int:
    """Leaves to visit so that the calibration queries find ``recall`` of their exact neighbours, those with equal vectors and those without each for themselves."""
    n = asked.count()
    if not n:
        return 1
    same = F.xxhash64("v").alias("same")
    drawn = asked.select("id", "v", same)
    chosen = drawn.where(F.abs(F.xxhash64("id", F.lit(5))) <= min(1.0, 8 * CALIBRATE / n) * float(2**63 - 1)).orderBy(F.xxhash64("id", F.lit(5))).collect() or drawn.limit(1).collect()
    sought = index.sparkSession.createDataFrame([(x,) for x in {r["same"] for r in chosen}], "same long")
    often = {r["same"] for r in index.select("id", same).join(F.broadcast(sought), "same").groupBy("same").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").collect()}
    enough = 1
    for copied in (False, True):
        queries = [(r["id"], np.array(r["v"])) for r in chosen if (r["same"] in often) == copied][:CALIBRATE]
        if not queries:
            continue
        order = {i: {leaf: at for at, leaf in enumerate(visits(np.append(q, 0.0), nodes))} for i, q in queries}
        ranks = sorted(order[r["query_id"]][r["leaf"]] for r in exact(index, queries, k).collect())
        if ranks:
            enough = max(enough, ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1)
    return enough
