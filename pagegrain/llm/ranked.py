"""Ranked lexical search: documents grouped by the mask of matched terms, best masks first.

Documents are cut into blocks. A task turns the postings of a block into one bitmap
a term, and for every item packs the bitmaps of its terms across: a column of the
packed bits is a document's mask of matched terms. Documents of one mask form a
group whose largest possible score is the sum of its terms' largest scores in the
block. Groups are scored in falling order of that sum until it lies below the k-th
score found, so what is left can't enter the result. The threshold stays for the
next block of the task; the best of all tasks meet in a ranking of at most k rows a
task and item.

The items' words reach the tasks by value, in slices of ``SLICE_BYTES`` of item text;
every slice scans the documents again. Only counts a term come back to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import column, cut, in_slices, packed, per_batch, trim, unpacked

#: Best documents of an item.
TOP = 10
#: Item text handed to the tasks at once.
SLICE_BYTES = 8 << 20
#: Documents of a block, and postings after which it ends early.
BLOCK, POSTINGS = 8192, 2_000_000
#: Groups scored at first; every further round takes twice as many.
ROUND = 64
#: Every byte of a term as it is, A-Z to a-z, all other ASCII bytes to a space.
TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()

POSTED = "ids binary, known binary, lengths binary, keys binary, tf binary, documents long, terms long, postings long"
_POSTED = pa.schema([*[(n, pa.binary()) for n in ("ids", "known", "lengths", "keys", "tf")], *[(n, pa.int64()) for n in ("documents", "terms", "postings")]])


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other characters beyond ASCII; A-Z lower-cased."""
    return text.translate(TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _posted(vocabulary: dict[bytes, int], block: int, postings: int):
    """Batches of (id, text) -> a row a block: postings of the vocabulary's terms by term and place in the block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, keys, tf, seen, total = [], [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            k = np.array(keys, np.int64)
            order = np.argsort(k, kind="stable")
            return per_batch({"ids": [packed(np.array([i or 0 for i in ids], np.int64))], "known": [packed(np.array([i is not None for i in ids], np.uint8))],
                              "lengths": [packed(np.array(lengths, np.int64))], "keys": [packed(np.diff(k[order], prepend=0))], "tf": [packed(np.array(tf, np.int32)[order])],
                              "documents": [seen], "terms": [total], "postings": [len(keys)]}, _POSTED)

        for found_ids, texts in in_slices(batches):
            for i, text in zip(found_ids, texts):
                ts = terms(text)
                seen, total = seen + bool(ts), total + len(ts)
                counts = Counter(ts)
                here = counts.keys() & vocabulary.keys()
                if here:
                    place = len(ids)
                    ids.append(i)
                    lengths.append(len(ts))
                    keys += [vocabulary[t] * block + place for t in here]
                    tf += [counts[t] for t in here]
                if len(ids) == block or len(keys) >= postings:
                    yield row()
                    ids, lengths, keys, tf, seen, total = [], [], [], [], 0, 0
        if seen:
            yield row()
    return run


_COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64())])


def _counted(n_terms: int, block: int):
    """Documents a term, one row a term and task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for keys in column(b, "keys"):
                df += np.bincount(np.cumsum(unpacked(keys, np.int64)) // block, minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], schema=_COUNTS)
    return run


class Block:
    """The postings of a block with the part of each score that does not depend on the item."""

    def __init__(self, row: dict, block: int, n_docs: int, n_terms: int):
        self.ids, self.known = unpacked(row["ids"], np.int64), unpacked(row["known"], np.uint8).astype(bool)
        keys, tf = np.cumsum(unpacked(row["keys"], np.int64)), unpacked(row["tf"], np.int32).astype(np.int64)
        m = np.array([25 + 75 * n * n_docs // n_terms for n in unpacked(row["lengths"], np.int64).tolist()], np.int64)
        self.places = keys % block
        self.part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.places])
        term = keys // block
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts[1:], len(term))
        self.most = dict(zip(term[starts].tolist(), np.maximum.reduceat(self.part, starts).tolist())) if len(term) else {}
        self.ranges = dict(zip(term[starts].tolist(), zip(starts.tolist(), ends.tolist())))

    def groups(self, item: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the documents that hold a term of the item, their masks' starts in that order, and each mask's largest score; best first."""
        bitmaps = np.zeros((len(item), len(self.ids)), bool)
        for row, (t, _) in zip(bitmaps, item):
            lo, hi = self.ranges[t]
            row[self.places[lo:hi]] = True
        at = np.flatnonzero(bitmaps.any(axis=0))
        bits = np.packbits(bitmaps[:, at], axis=0)
        words = np.zeros((len(at), -(-len(bits) // 8) * 8), np.uint8)
        words[:, :len(bits)] = bits.T
        masks = words.view(np.uint64)
        order = np.argsort(masks[:, 0], kind="stable") if masks.shape[1] == 1 else np.lexsort(masks.T)
        masks = masks[order]
        starts = np.flatnonzero(np.append(True, (masks[1:] != masks[:-1]).any(axis=1)))
        held = np.unpackbits(words[order[starts]], axis=1, count=len(item))
        return at[order], starts, held @ np.array([w * self.most[t] for t, w in item], np.int64)

    def scores(self, item: list[tuple[int, int]], at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for t, w in item:
            lo, hi = self.ranges[t]
            here = self.places[lo:hi]
            found = np.minimum(np.searchsorted(here, at), hi - lo - 1)
            out += np.where(here[found] == at, w * self.part[lo:hi][found], 0)
        return out

    def best(self, item: list[tuple[int, int]], top: "Best") -> None:
        item = [(t, w) for t, w in item if t in self.ranges]
        if not item or sum(w * self.most[t] for t, w in item) < top.least:
            return
        at, starts, bounds = self.groups(item)
        ends, falling = np.append(starts[1:], len(at)), np.argsort(-bounds, kind="stable")
        done, step = 0, ROUND
        while done < len(falling) and bounds[falling[done]] >= top.least:
            some = falling[done:done + step]
            some = some[bounds[some] >= top.least]
            sizes = ends[some] - starts[some]
            at_once = at[np.repeat(starts[some] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())]
            top.add(self.scores(item, at_once), self.ids[at_once], self.known[at_once])
            done, step = done + step, 2 * step


class Best:
    """The k best (score, id) so far; of equal scores the smaller id, ids before nulls."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = scores >= self.least
        s, i, n = (np.concatenate([a, b[good]]) for a, b in zip(self.rows, (scores, ids, known)))
        order = np.lexsort((i, ~n, -s))[:self.k]
        self.rows = s[order], i[order], n[order]
        if len(order) == self.k:
            self.least = int(self.rows[0][-1])


def _ranked(items: list[list[tuple[int, int]]], n_docs: int, n_terms: int, block: int, k: int):
    schema = pa.schema([("item", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Best(k) for _ in items]
        for b in batches:
            for j in range(b.num_rows):
                here = Block(b.slice(j, 1).to_pylist()[0], block, n_docs, n_terms)
                for item, top in zip(items, tops):
                    here.best(item, top)
        for number, top in enumerate(tops):
            s, i, known = top.rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), number)), pa.array(i, mask=~known), pa.array(s)], schema=schema)
        trim()
    return run


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           k: int = TOP, slice_bytes: int = SLICE_BYTES, block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """The ``k`` best documents of every item: the item's id, rank (from 1), the document's id (a whole number), score.

    Null and empty texts have no terms: such documents are not counted, such items
    have no rows. Equal rows of ``items`` are one item; rows that share an id but
    not the text are ranked each on its own. Every row of ``docs`` is a document of
    its own, repeated ids too; of equal scores the smaller id goes first, null ids
    go last. Without documents there are no rows. Other columns are not read.
    """
    spark, kind = docs.sparkSession, items.schema[item].dataType.simpleString()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    wanted = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("text")).where(F.octet_length("text") > 0).distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // slice_bytes)
    out = spark.createDataFrame([], f"{item} {kind}, rank int, {key} long, score long") if not slices else None
    for s in range(slices):
        here = wanted if slices == 1 else wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == s)
        rows = [(r["item"], Counter(terms(bytes(r["text"])))) for r in here.collect()]
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*[c for _, c in rows])))}
        posted = cut(texts.mapInArrow(_posted(vocabulary, block, postings), POSTED), "postings")
        total = posted.agg(F.sum("documents"), F.sum("terms")).first()
        df = dict(posted.where("postings > 0").mapInArrow(_counted(len(vocabulary), block), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
        n_docs, n_terms = total[0] or 0, total[1] or 0
        wants = [[(n, w * q) for t, q in c.items() if (n := vocabulary[t]) in df and (w := weight(n_docs, df[n]))] for _, c in rows]
        found = posted.where("postings > 0").mapInArrow(_ranked(wants, n_docs, n_terms, block, k), "number long, id long, score long")
        best = W.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], f"number long, item {kind}")
        part = (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(names, "number")
                .select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score"))
        part = part if slices == 1 else cut(part, "ranked")
        out = part if out is None else out.unionByName(part)
    return out
