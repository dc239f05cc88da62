"""N-gram Jaccard join: a blocked sparse product of the incidence of documents and n-grams.

A document is the set of its five-word shingles, as 64-bit hashes. Two documents
link when 100 * |intersection| >= 80 * |union|. Rows of the incidence matrix that
are equal are one class. Its columns are ordered by rarity; of a row of n entries
the first n - ceil(0.8 n) + 1 are its prefix, and linked rows share a column of
their prefixes. The product runs over blocks of columns (buckets of shingles),
in three steps:

1. In a column, every row is multiplied with two others alone: the column's first
   row and, in a large column, the next in an order of its own. What links becomes
   components. So a group of near copies costs a few pairs a member.
2. Columns of three rows or more that lie in more than one component are
   multiplied in full, but for pairs inside a component.
3. The rows of the pairs that both steps name are multiplied block by block: the
   overlap adds up over blocks of columns, and a pair goes as soon as the entries
   that are left cannot reach the overlap its sizes ask for.

In steps 1 and 2 a pair is named only if its sizes, and the entries that follow
the shared column, can reach that overlap.

Rarity: 40-bit fingerprints of all shingles are counted, and the ``FREQUENT``
commonest go to the tasks as sorted arrays; any order gives the same links, so
the bound costs nothing but time. A column that holds more than ``HOT`` documents
is split over buckets; the first rows of its parts meet in a column of their own.

A text with fewer than five words is one shingle, the whole sequence; without
words it has none and links with nothing. Rows with equal keys are one document
for the links; a null key takes no part in them. An empty table gives an empty
result. Hashes of 64 bits stand for shingles in columns, 48
bits of them where two documents are compared, and 128 bits for sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrain.llm.common import Hashes, cut, in_slices, mixed, packed, sorted_packed, sorted_unpacked, trim, unpacked, words
from pagegrain.llm.components import components

WORDS = 5
PERCENT = 80
FREQUENT = 1 << 19
LEAST_FREQUENT = 8
HOT = 2_000
#: Documents in a column from which each is also paired with the next.
CHAINED = 16
#: Blocks of columns, a power of two, over which the overlap of a pair is added up.
BLOCKS = 8
#: Earlier columns of a document that are looked at to meet a pair once.
BACK = 4
BROADCAST_ROWS = 1 << 20
_STEP = 1 << 21
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(ws: list[bytes], hashes: Hashes) -> np.ndarray:
    """Distinct shingles of a text, ascending."""
    if not ws:
        return np.zeros(0, np.uint64)
    h = hashes.of(ws)
    k = min(WORDS, h.size)
    out = np.full(h.size - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _K + h[j:h.size - k + 1 + j]
    return np.unique(mixed(out))


def prefix_length(n: int) -> int:
    return n + (-PERCENT * n // 100) + 1


def _buckets(docs: DataFrame) -> int:
    return max(8, 4 * docs.rdd.getNumPartitions())


def _split(values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of ascending 64-bit values dealt by their highest bits."""
    to = (values >> np.uint64(40)).astype(np.int64) * buckets >> 24
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    return [(int(to[i]), int(i), int(j)) for i, j in zip(starts, [*starts[1:], len(to)])]


def sketches(docs: DataFrame) -> DataFrame:
    """Per row key, n and fp (null without words); and packed fingerprint counts by bucket. Written to the shared folder."""
    buckets = _buckets(docs)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def build(batches):
        hashes, seen, waiting, size = Hashes(200_000), set(), [], 0

        def counted():
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            rows = [(k, sorted_packed(values[i:j]), packed(counts[i:j].astype(np.uint32))) for k, i, j in _split(values, buckets)]
            none = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((none, none, none, *zip(*rows)), schema)], schema=schema)

        for keys, texts in in_slices(batches):
            out = []
            for key, text in zip(keys, texts):
                s = shingles(words(text), hashes)
                fp = xxhash.xxh3_128_digest(s.tobytes()) if s.size else None
                out.append((key, s.size, fp, None, None, None))
                if fp and fp not in seen:
                    seen.add(fp)
                    waiting.append(np.unique(s >> np.uint64(24) << np.uint64(24)))
                    size += s.size
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            if size >= _STEP:
                yield counted()
                waiting, size = [], 0
        if size:
            yield counted()
        waiting.clear()
        trim()

    return cut(docs.mapInArrow(build, "key long, n long, fp binary, bucket int, grams binary, counts binary"), "sketches")


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest fingerprints, ascending, and how many documents hold each: ``FREQUENT`` of them at most."""

    def total(table: pa.Table) -> pa.Table:
        grams = np.concatenate([sorted_unpacked(x) for x in table.column("grams").to_pylist()])
        n = np.concatenate([unpacked(x, np.uint32) for x in table.column("counts").to_pylist()])
        values, at = np.unique(grams, return_inverse=True)
        sums = np.bincount(at, n).astype(np.int64)
        keep = sums >= LEAST_FREQUENT
        trim()
        return pa.table({"gram": values[keep].view(np.int64), "df": sums[keep]})

    found = cut(counts.groupBy("bucket").applyInArrow(total, "gram long, df long"), "frequencies")
    levels = {r["level"]: r["n"] for r in found.groupBy(F.floor(F.log2("df") * 8).alias("level")).agg(F.count("*").alias("n")).collect()}
    least, kept = 0, 0
    for level in sorted(levels, reverse=True):
        if kept + levels[level] > FREQUENT:
            least = level + 1
            break
        kept += levels[level]
    rows = found.where(F.floor(F.log2("df") * 8) >= least).toPandas()
    grams, df = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["df"].to_numpy(np.int64)
    order = np.argsort(grams)
    return grams[order], df[order]


def postings(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Packed prefix entries by bucket of their column: column, real column where split, key, n, position."""
    buckets, shared = _buckets(docs), docs.sparkSession.sparkContext.broadcast(common)
    names = ("gram", "real", "key", "n", "pos")
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in names)])

    def build(batches):
        grams, df = shared.value
        hashes, seen, waiting, size = Hashes(200_000), set(), [], 0

        def dealt():
            g, real, key, n, pos = (np.concatenate(x) for x in zip(*waiting))
            order = np.argsort(g)
            cols = [x[order] for x in (g, real, key, n, pos)]
            rows = [(k, sorted_packed(cols[0][i:j]), *(packed(x[i:j]) for x in cols[1:])) for k, i, j in _split(cols[0], buckets)]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for keys, texts in in_slices(batches):
            for key, text in zip(keys, texts):
                s = shingles(words(text), hashes)
                if key is None or not s.size or (fp := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(fp)
                p, many = prefix_length(s.size), np.zeros(s.size, np.int64)
                if grams.size:
                    short = s >> np.uint64(24) << np.uint64(24)
                    at = np.minimum(np.searchsorted(grams, short), grams.size - 1)
                    many = np.where(grams[at] == short, df[at], 0)
                order = np.argsort(many, kind="stable")[:p]
                g, many = s[order], many[order]
                parts = np.maximum(1, -(-many // HOT)).astype(np.uint64)
                real = np.where(parts > 1, g, np.uint64(0))
                part = mixed(np.full(1, key, np.int64).view(np.uint64))[0] % parts
                g = np.where(parts > 1, mixed(g + (part + np.uint64(1)) * _K), g)
                waiting.append((g, real, np.full(p, key, np.int64), np.full(p, s.size, np.uint32), np.arange(p, dtype=np.uint32)))
                size += p
            if size >= _STEP // 4:
                yield dealt()
                waiting, size = [], 0
        if size:
            yield dealt()
        waiting.clear()
        trim()

    return docs.mapInArrow(build, "bucket int, gram binary, real binary, key binary, n binary, pos binary")


STAR = "gram long, real long, key long, n long, pos long, pivot long, may boolean, next long, may_next boolean"


def may_link(n, pos, other_n, other_pos):
    """Whether documents that meet in a column at these positions can overlap enough, by length and by what follows."""
    need = -(-PERCENT * (n + other_n) // (100 + PERCENT))
    return (np.minimum(n - pos, other_n - other_pos) >= need) & (100 * np.minimum(n, other_n) >= PERCENT * np.maximum(n, other_n))


def stars(packed_postings: DataFrame) -> DataFrame:
    """The entries of the columns with the first of their column. Written to the shared folder.

    Of a column of two documents only the pair is kept, and only where it may
    link; of a larger one every entry, with the next one in an order that differs
    from column to column; of a split one also single entries.
    """

    def meet(table: pa.Table) -> pa.Table:
        kinds = {"real": np.uint64, "key": np.int64, "n": np.uint32, "pos": np.uint32}
        g = np.concatenate([sorted_unpacked(x) for x in table.column("gram").to_pylist()])
        cols = {c: np.concatenate([unpacked(x, t) for x in table.column(c).to_pylist()]) for c, t in kinds.items()}
        order = np.lexsort((cols["key"], g))
        g, cols = g[order], {c: x[order].view(np.int64) if x.dtype.itemsize == 8 else x[order].astype(np.int64) for c, x in cols.items()}
        new = np.ones(g.size, bool)
        new[1:] = (g[1:] != g[:-1]) | (cols["key"][1:] != cols["key"][:-1])
        g, cols = g[new], {c: x[new] for c, x in cols.items()}
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        sizes = np.diff(starts, append=g.size)
        pivot, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        other = np.arange(g.size) != pivot
        may = other & may_link(cols["n"], cols["pos"], cols["n"][pivot], cols["pos"][pivot])
        use = (size > 2) | may | (cols["real"] != 0)
        turn = np.lexsort((mixed(cols["key"].view(np.uint64) ^ g), g))
        here, after = turn[:-1], turn[1:]
        follows, may_next = np.arange(g.size), np.zeros(g.size, bool)
        follows[here] = after
        may_next[here] = (g[here] == g[after]) & (size[here] > CHAINED) & may_link(cols["n"][here], cols["pos"][here], cols["n"][after], cols["pos"][after])
        out = {"gram": g.view(np.int64), **cols, "pivot": cols["key"][pivot], "may": may, "next": cols["key"][follows], "may_next": may_next}
        trim()
        return pa.table({c: out[c][use] for c in ("gram", "real", "key", "n", "pos", "pivot", "may", "next", "may_next")})

    return cut(packed_postings.groupBy("bucket").applyInArrow(meet, STAR), "stars")


def set_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, grams: the shingles of these documents, packed, by 48 bits of their hash, written to the shared folder."""
    keys = cut(keys.distinct(), "keys")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)

    def build(batches):
        hashes = Hashes(200_000)
        for ks, texts in in_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([sorted_packed(np.unique(shingles(words(t), hashes) >> np.uint64(16))) for t in texts], pa.binary())], ["key", "grams"])

    return cut(docs.join(keys, "key", "left_semi").mapInArrow(build, "key long, grams binary"), "sets")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    pairs = cut(pairs, "pairs")
    sets = set_of(docs, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))))

    def reach(x: np.ndarray, y: np.ndarray) -> bool:
        """Adds up the overlap block of columns by block, as long as what is left can still reach the overlap that the sizes ask for."""
        need, shared = -(-PERCENT * (x.size + y.size) // (100 + PERCENT)), 0
        edges = np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(48 - BLOCKS.bit_length() + 1)
        xs, ys = [0, *np.searchsorted(x, edges).tolist(), x.size], [0, *np.searchsorted(y, edges).tolist(), y.size]
        for i in range(BLOCKS):
            if shared + min(x.size - xs[i], y.size - ys[i]) < need:
                return False
            both = np.concatenate((x[xs[i]:xs[i + 1]], y[ys[i]:ys[i + 1]]))
            both.sort()
            shared += int((both[1:] == both[:-1]).sum())
        return shared >= need

    def judge(batches):
        for b in batches:
            keep = [reach(sorted_unpacked(x), sorted_unpacked(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    return cut(both.select("a", "b", "ga", "gb").mapInArrow(judge, "a long, b long"), "links")


def first_pairs(columns: DataFrame) -> DataFrame:
    """a < b: every entry with the first and the next of its column, where they may link; and the first of the parts of a split column."""
    chain = columns.where("may_next").select(F.least("key", "next").alias("a"), F.greatest("key", "next").alias("b"))
    direct = columns.where("may").select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    tops = columns.where((F.col("real") != 0) & (F.col("key") == F.col("pivot"))).select("real", "pivot")
    least = tops.groupBy("real").agg(F.min("pivot").alias("a"))
    across = tops.join(least, "real").where(F.col("a") != F.col("pivot")).select("a", F.col("pivot").alias("b"))
    return direct.unionByName(chain).unionByName(across).distinct()


def rest_pairs(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """a < b in different components that may link, from the columns of three documents or more that hold more than one component.

    A pair in a column of two has been tested; of linked documents, the first
    column that they share shows that they may link. So a column is skipped for a
    pair that also shares one of the last ``BACK`` open columns of either: the
    pair has been met there, or before.
    """
    gram = F.when(F.col("real") != 0, F.col("real")).otherwise(F.col("gram"))
    many = columns.select(gram.alias("gram"), "key", "n", "pos")
    rows = many.join(labels, F.col("key") == F.col("node"), "left").select("gram", "key", "n", "pos", F.coalesce("label", "key").alias("label"))
    open_ = rows.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
    open_ = open_.where((F.col("lo") != F.col("hi")) & (F.col("size") > 2)).select("gram")
    rows = rows.join(open_, "gram", "left_semi")
    mine, all_mine = Window.partitionBy("key").orderBy("pos", "gram"), Window.partitionBy("key")
    last = F.array_compact(F.array(*(F.lag("gram", i).over(mine) for i in range(1, BACK + 1))))
    one_text = F.min("n").over(all_mine) == F.max("n").over(all_mine)
    rows = cut(rows.withColumn("last", F.when(one_text, last).otherwise(F.array().cast("array<bigint>"))), "open-columns")
    x = rows.select("gram", F.col("last").alias("ga"), F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
    y = rows.select("gram", F.col("last").alias("gb"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
    need = F.ceil(PERCENT * (F.col("na") + F.col("nb")) / F.lit(100 + PERCENT))
    may = (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return x.join(y, "gram").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & may & ~F.arrays_overlap("ga", "gb")).select("a", "b").distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row, and n_copies: rows with the same set."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    sketch = sketches(rows)
    sets = sketch.where(F.col("bucket").isNull()).select("key", "n", "fp")
    columns = stars(postings(rows, frequent(sketch.where(F.col("bucket").isNotNull()).select("bucket", "grams", "counts"))))
    classes = sets.where(F.col("fp").isNotNull() & F.col("key").isNotNull()).groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n_copies"))
    member = cut(sets.join(classes, "fp", "left").select("key", "n", "fp", "rep", "n_copies"), "classes")
    copies = member.where(F.col("key") != F.col("rep")).select(F.col("key").alias("a"), F.col("rep").alias("b"))
    links = verified(rows, first_pairs(columns))
    labels = components(copies.unionByName(links))
    more = verified(rows, rest_pairs(columns, labels))
    if more.take(1):
        joined = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = components(joined.unionByName(more))
    out = member.join(labels, F.col("key") == F.col("node"), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("label", "key").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the smallest of their component, with their columns; null keys stay."""
    found = join(docs, key, text).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct()
    gone = cut(found, "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")
