"""Language-model scores by Katz backoff over words.

Tokens are lower-cased words, then one end. Counts come from the rows where
``train`` holds. The model is a Katz model of n-grams up to ``order``: an n-gram
seen c times, at least ``least`` times, has d(c) * c / c(history); the mass that is
left goes to all other words in proportion to their probability one order lower,
down to the unigrams, so that every history is exactly normalised. A history whose
n-grams leave no mass counts as seen once more. Unigrams are discounted too, and
what the discounts free belongs to the unknown word. The discounts are Good-Turing
ratios for counts up to ``DISCOUNTED``, from the counts of counts of all n-grams of
an order; where the data make a ratio senseless it is 1. The first word follows a
start that is no token, and no history reaches beyond the start.

``ORDER`` and ``least`` = 1, which keeps every n-gram, are the whole model; without
arguments ``score`` is the bigram model of the n-grams seen ``MIN_COUNT`` times.

The texts are blocks of word numbers (``blocks``). Word counts are summed by
bucket of the word and return to the blocks; n-grams of a block go by their hash
to buckets, and only counts return, in the order that the block knows. Each
stored n-gram is told once by one block that holds it. For the backoff weights a
block sends sums by history, by bucket of their hash, and gets back the weights
that its own tokens need: of histories with an n-gram not stored, or with one that
lost nothing. An n-gram that one block alone holds is weighed there and not sent.
Nothing is joined word by word, and no history gathers in one task.
The table of stored n-grams is worked out only where it is read.

Null and empty texts are the end alone. Equal rows each give a row. A null key
counts as any other. Without training rows all words are unknown and the base is
that of an empty vocabulary. Only key and results are returned. N-grams are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagegrain.llm.blocks import buckets_for, by_bucket, token_blocks
from pagegrain.llm.common import cut, mixed, packed, trim, unpacked, unpacked_words, words

ORDER = 3
MIN_COUNT = 2
DISCOUNTED = 5
#: Items of a block that a formula works on at a time.
PART = 1 << 17
#: What stands for the end and the start; no word holds white space.
END, START = b"\n", b"\t"
_K = np.uint64(0x9E3779B97F4A7C15)
#: Marks beside the count of an n-gram.
TELLS, ALONE = np.uint64(1 << 63), np.uint64(1 << 62)


def discounts(n: list[int], least: int = 1) -> np.ndarray:
    """d(0) .. d(DISCOUNTED): Good-Turing ratios from the numbers of n-grams seen 1, 2, .. times; 0 below ``least``."""
    d = np.ones(DISCOUNTED + 1)
    d[0] = 0.0
    top = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0] if n[0] else 1.0
    for r in range(1, DISCOUNTED + 1):
        if r < least:
            d[r] = 0.0
        elif n[r - 1] and n[r] and top < 1:
            ratio = ((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top)
            d[r] = ratio if 0 < ratio <= 1 else 1.0
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED).astype(np.int64)], 1.0) * c


class Unigrams:
    """Probabilities of words by their count, and of the unknown word; they add up to one."""

    def __init__(self, total: int, distinct: int, counts: list[int]):
        self.total, self.distinct, self.d = total, distinct, discounts(counts)
        freed = sum((1 - self.d[r]) * r * counts[r - 1] for r in range(1, DISCOUNTED + 1))
        self.unknown = max(freed / total, 1 / (total + 1)) if total else 1.0
        self.scale = (1 - self.unknown) / (total - freed) if total and total > freed else 0.0

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.scale, self.unknown)


def pair_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(history) * _K + word)


def order_of(h: np.ndarray) -> np.ndarray:
    """Places in ascending order of the hashes: their highest bits are sorted with the place beside them, which is several times as fast as an argsort."""
    low = np.uint64((1 << max(len(h) - 1, 0).bit_length()) - 1)
    by = h & ~low
    by |= np.arange(len(h), dtype=np.uint64)
    by.sort()
    by &= low
    by = by.view(np.int64)
    sorted_ = h[by]
    # Hashes that differ in the lowest bits alone may lie between each other.
    return by if (sorted_[1:] >= sorted_[:-1]).all() else np.argsort(h, kind="stable")


def parts(n: int) -> list[slice]:
    """Slices of ``PART`` items, so that what a formula makes on its way is never as long as a block."""
    return [slice(i, i + PART) for i in range(0, n, PART)]


def trimmed(f):
    """``f`` of one or two tables, after which all that it held returns to the system."""
    def ended(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        trim()
        return out

    def one(t: pa.Table) -> pa.Table:
        return ended(t)

    def two(t: pa.Table, u: pa.Table) -> pa.Table:
        return ended(t, u)

    return one if f.__code__.co_argcount == 1 else two


def count_columns(c: np.ndarray) -> list[int]:
    """Sum, number, and numbers of those that are 1 .. DISCOUNTED + 1."""
    return [int(c.sum()), int((c > 0).sum()), *(int((c == r).sum()) for r in range(1, DISCOUNTED + 2))]


STATS = ["total", "distinct", *(f"n{r}" for r in range(1, DISCOUNTED + 2))]


class Grams(NamedTuple):
    """Distinct n-grams of a block in the order of their hash, and the place of every token's n-gram among them, -1 without.

    ``history`` counts among the n-grams one shorter (words, for bigrams), and so does
    ``lower``, the n-gram without its first word; ``n`` is the training count.
    """

    h: np.ndarray
    history: np.ndarray
    word: np.ndarray
    lower: np.ndarray
    n: np.ndarray
    place: np.ndarray


class Block:
    """A block's rows unpacked: sequence with histories, hashes and training marks."""

    def __init__(self, row: dict):
        self.seq, self.ends = unpacked(row["seq"], np.int32), unpacked(row["ends"], np.int64)
        self.words = unpacked_words(row["words"])
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [*self.words, START]), np.uint64, len(self.words) + 1)
        self.lengths = np.diff(self.ends, prepend=0)
        self.train = np.repeat(np.array(row["flags"], bool), self.lengths)

    def grams(self, order: int) -> Iterator[Grams]:
        """N-grams of 2 .. ``order`` words, one length after the other; places are 32-bit numbers."""
        at = np.arange(len(self.seq), dtype=np.int32)
        at -= np.repeat((self.ends - self.lengths).astype(np.int32), self.lengths)
        place, hashes = self.seq, self.hashes
        for m in range(2, order + 1):
            before = np.roll(place, 1)
            if m == 2:
                before[at == 0] = len(self.words)
            whole = np.flatnonzero(at >= m - 2).astype(np.int32)
            each = np.empty(len(whole), np.uint64)
            for s in parts(len(whole)):
                each[s] = pair_hash(hashes[before[whole[s]]], self.hashes[self.seq[whole[s]]])
            by = order_of(each)
            h, whole = each[by], whole[by]
            del each, by
            new = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=new[1:])
            h, first, starts = h[new], whole[new], np.flatnonzero(new)
            n = np.add.reduceat(self.train[whole], starts, dtype=np.uint32) if len(starts) else np.zeros(0, np.uint32)
            rank = np.cumsum(new, dtype=np.int32)
            rank -= 1
            here = np.full(len(self.seq), -1, np.int32)
            here[whole] = rank
            del whole, new, starts, rank
            yield Grams(h, before[first], self.seq[first], place[first], n, here)
            place, hashes = here, h


def cuts_of(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    to = (h >> np.uint64(40)).astype(np.int64) * buckets >> 24
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    return [(int(to[i]), int(i), int(j)) for i, j in zip(starts, [*starts[1:], len(to)])]


ANSWER = "block long, bucket int, level int, payload binary, " + ", ".join(f"{s} long" for s in STATS)
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("level", pa.int32()), ("payload", pa.binary()), *((s, pa.int64()) for s in STATS)])
DEALT = "level int, bucket int, block long, hashes binary, counts binary"
_DEALT = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
SUMS = "bucket int, block long, hashes binary, sums binary, seen binary, told binary, at binary"
_SUMS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((s, pa.binary()) for s in ("hashes", "sums", "seen", "told", "at"))])


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def answers(rows: list[tuple], level: int, stats: list[int]) -> pa.Table:
    rows = [(*r[:2], level, r[2], *[None] * len(STATS)) for r in rows] + [(None, None, level, None, *stats)]
    return pa.Table.from_batches([rows_of(rows, _ANSWER)])


def summed(answers_: DataFrame, level: int) -> list[int]:
    r = answers_.where(F.col("block").isNull() & (F.col("level") == level)).agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS)).first()
    return [int(r[s]) for s in STATS]


def in_order(table: pa.Table, level: int, dtype) -> np.ndarray:
    """The counts of a level side by side, by bucket."""
    rows = sorted((b, p) for b, p, x, k in zip(*(column_of(table, c) for c in ("bucket", "payload", "level", "kind"))) if k == "count" and x == level)
    return np.concatenate([*(unpacked(p, dtype) for _, p in rows), np.zeros(0, dtype)])


def column_of(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = 2, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(scores, n-grams): per row key, trained, n_tokens, n_known, train_tokens, base_score and score; and the table of stored n-grams."""
    buckets = buckets_for(docs)

    def pieces(t: bytes | None) -> list[bytes]:
        return [*words(t), END]

    blocks = token_blocks(docs, key, text, pieces, flag=F.coalesce(train, F.lit(False)))
    whole = ["block", "flags", "ends", "seq", "words"]

    def count_words(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                by, cuts = by_bucket(block.words, buckets)
                n = np.bincount(block.seq, block.train, len(block.words)).astype(np.uint32)
                yield rows_of([(1, k, row["block"], packed(block.hashes[by[i:j]]), packed(n[by[i:j]])) for k, i, j in cuts], _DEALT)
        trim()

    @trimmed
    def total_words(t: pa.Table) -> pa.Table:
        hs, ns = [unpacked(x, np.uint64) for x in column_of(t, "hashes")], [unpacked(x, np.uint32) for x in column_of(t, "counts")]
        values, of = np.unique(np.concatenate(hs), return_inverse=True)
        sums = np.bincount(of, np.concatenate(ns)).astype(np.int64)
        back = np.split(sums[of], np.cumsum([len(h) for h in hs])[:-1])
        return answers([(block, bucket, packed(c.astype(np.uint32))) for block, bucket, c in zip(column_of(t, "block"), column_of(t, "bucket"), back)], 1, count_columns(sums))

    word_counts = cut(blocks.select(*whole).mapInArrow(count_words, DEALT).groupBy("bucket").applyInArrow(total_words, ANSWER), "word-counts")
    total, distinct, *of_counts = summed(word_counts, 1)
    uni = (total, distinct, of_counts)

    def grams_of(row: dict):
        for level, g in enumerate(Block(row).grams(order), 2):
            h, n = g.h, g.n
            del g
            yield rows_of([(level, k, row["block"], packed(np.diff(h[i:j], prepend=np.uint64(0))), packed(n[i:j])) for k, i, j in cuts_of(h, buckets)], _DEALT)

    def count_grams(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from grams_of(row)
        trim()

    @trimmed
    def total_grams(t: pa.Table) -> pa.Table:
        """Counts of the stored n-grams, 0 for others; ``TELLS`` marks the block that tells the n-gram, ``ALONE`` the only block that holds it."""
        hs, ns = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in column_of(t, "hashes")], [unpacked(x, np.uint32) for x in column_of(t, "counts")]
        values, first, of = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        sums = np.bincount(of, np.concatenate(ns)).astype(np.int64)
        c = np.where(sums >= least, sums, 0)[of].astype(np.uint64)
        tells = np.zeros(len(of), bool)
        tells[first] = True
        c |= np.where(tells & (c > 0), TELLS, np.uint64(0)) | np.where((np.bincount(of) == 1)[of], ALONE, np.uint64(0))
        back = np.split(c, np.cumsum([len(h) for h in hs])[:-1])
        return answers([(block, bucket, packed(x)) for block, bucket, x in zip(column_of(t, "block"), column_of(t, "bucket"), back)], column_of(t, "level")[0], count_columns(sums))

    gram_counts = cut(blocks.select(*whole).mapInArrow(count_grams, DEALT).groupBy("level", "bucket").applyInArrow(total_grams, ANSWER), "gram-counts")
    d = [discounts(summed(gram_counts, level)[2:], least) for level in range(2, order + 1)]
    starts = docs.where(train).count()
    counted = word_counts.unionByName(gram_counts).where(F.col("block").isNotNull())
    told = counted.select("block", "bucket", "level", "payload", F.lit("count").alias("kind"), F.lit(None).cast("binary").alias("at"))

    def numbers(row: dict, answer: pa.Table, levels: int):
        """A block, its n-grams, the counts of words (and the start) and of n-grams, who tells them, which are here alone, and the probabilities of all below the last ``levels``."""
        block = Block(row)
        grams = list(block.grams(levels + 1))
        c = np.full(len(block.words) + 1, starts, np.int64)
        c[by_bucket(block.words, buckets)[0]] = in_order(answer, 1, np.uint32)
        counts, tells, alone, p = [c], [], [np.zeros(len(c), bool)], [Unigrams(*uni).of(c)]
        for level in range(2, levels + 2):
            b = in_order(answer, level, np.uint64)
            tells.append(b & TELLS > 0)
            alone.append(b & ALONE > 0)
            b &= ~(TELLS | ALONE)
            counts.append(b.view(np.int64))
        return block, grams, counts, tells, alone, p

    def sums_of(m: int, g: Grams, counts: list, p: list, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By history: what the n-grams ``mine`` take and have one order lower, and whether there are any."""
        h, size, take = g.history[mine].astype(np.int64), len(counts[m]), np.empty(len(mine))
        for s in parts(len(mine)):
            take[s] = discounted(counts[m + 1][mine[s]], d[m]) / counts[m][h[s]]
        any_ = np.zeros(size, bool)
        any_[h] = True
        return np.bincount(h, take, size), np.bincount(h, p[m][g.lower[mine]], size), any_

    def weights_of(taken: np.ndarray, lower: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = np.where(taken > 1 - 1e-9, seen / (seen + 1), 1.0)
        return (1 - scale * taken) / (1 - lower), scale

    def climb(grams: list[Grams], counts: list, alone: list, p: list, answer: pa.Table, levels: int) -> None:
        """Adds the probabilities of the n-grams of the first ``levels`` orders above words, each from the one below."""
        for m, g in enumerate(grams[:levels]):
            weight, scale = np.ones(len(counts[m])), np.ones(len(counts[m]))
            if alone[m].any():
                taken, lower, any_ = sums_of(m, g, counts, p, np.flatnonzero(alone[m][g.history] & (counts[m + 1] > 0)))
                weight[any_], scale[any_] = weights_of(taken[any_], lower[any_], counts[m][any_])
            for at, payload, k, level in zip(*(column_of(answer, c) for c in ("at", "payload", "kind", "level"))):
                if k == "weight" and level == m + 2:
                    i = unpacked(at, np.uint32)
                    weight[i], scale[i] = np.split(unpacked(payload, np.float64), 2)
            each = np.empty(len(g.h))
            for s in parts(len(each)):
                n, h = counts[m + 1][s], g.history[s]
                each[s] = np.where(n > 0, scale[h] * discounted(n, d[m]) / np.maximum(counts[m][h], 1), weight[h] * p[m][g.lower[s]])
            p.append(each)

    def summing(m: int):
        @trimmed
        def sum_up(row_: pa.Table, answer: pa.Table) -> pa.Table:
            """By bucket: the histories of n-grams told here with their sums, and those whose weight this block needs, with where it needs it."""
            row = row_.to_pylist()[0]
            block, grams, counts, tells, alone, p = numbers(row, answer, m + 1)
            climb(grams, counts, alone, p, answer, m)
            g = grams[m]
            taken, lower, tell = sums_of(m, g, counts, p, np.flatnonzero(tells[m] & ~alone[m][g.history]))
            asks = np.zeros(len(tell), bool)
            for s in parts(len(g.h)):
                n, h = counts[m + 1][s], g.history[s]
                seen = counts[m][h]
                asks[h[~alone[m][h] & (seen > 0) & (n - discounted(n, d[m]) <= 2e-9 * seen)]] = True
            used = np.flatnonzero(tell | asks)
            h = (grams[m - 1].h if m else block.hashes)[used]
            by = order_of(h)
            h, used = h[by], used[by]
            rows = []
            for k, i, j in cuts_of(h, buckets):
                u = used[i:j]
                t = u[tell[u]]
                marks = tell[u].astype(np.uint8) + 2 * asks[u].astype(np.uint8)
                rows.append((k, row["block"], packed(np.diff(h[i:j], prepend=np.uint64(0))), packed(np.concatenate((taken[t], lower[t]))), packed(counts[m][t]), packed(marks), packed(u[asks[u]].astype(np.uint32))))
            return pa.Table.from_batches([rows_of(rows, _SUMS)])
        return sum_up

    @trimmed
    def weigh(t: pa.Table) -> pa.Table:
        """at, and weights and then scales of the histories a block asked for; those without stored n-grams are left out, both are 1 for them."""
        hs, marks = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in column_of(t, "hashes")], [unpacked(x, np.uint8) for x in column_of(t, "told")]
        values, of = np.unique(np.concatenate(hs), return_inverse=True)
        tell = of[np.concatenate(marks) & 1 > 0]
        taken, lower = (np.concatenate(x) for x in zip(*(np.split(unpacked(x, np.float64), 2) for x in column_of(t, "sums"))))
        seen = np.zeros(len(values))
        seen[tell] = np.concatenate([unpacked(x, np.int64) for x in column_of(t, "seen")])
        taken, lower = np.bincount(tell, taken, len(values)), np.bincount(tell, lower, len(values))
        weight, scale = weights_of(taken, lower, seen)
        rows = []
        for block, at, mark, here in zip(column_of(t, "block"), column_of(t, "at"), marks, np.split(of, np.cumsum([len(h) for h in hs])[:-1])):
            here, at = here[mark & 2 > 0], unpacked(at, np.uint32)
            found = seen[here] > 0
            if found.any():
                rows.append((block, packed(at[found]), packed(np.concatenate((weight[here[found]], scale[here[found]])))))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "at", "payload"])

    def telling(m: int):
        @trimmed
        def tell(row_: pa.Table, answer: pa.Table) -> pa.Table:
            block, grams, counts, tells, alone, p = numbers(row_.to_pylist()[0], answer, m + 1)
            climb(grams, counts, alone, p, answer, m)
            g, mine = grams[m], np.flatnonzero(tells[m])
            n, seen = counts[m + 1][mine], counts[m][g.history[mine]]
            return pa.table({"order": np.full(len(mine), m + 2, np.int32), "history": (grams[m - 1].h if m else block.hashes)[g.history[mine]].view(np.int64), "word": block.hashes[g.word[mine]].view(np.int64),
                             "n": n, "seen": seen, "p": discounted(n, d[m]) / seen, "lower": p[m][g.lower[mine]]})
        return tell

    stored = None
    for m in range(order - 1):
        met = blocks.select(*whole).groupBy("block").cogroup(told.where(F.col("level") <= m + 2).groupBy("block"))
        mine = met.applyInArrow(telling(m), "order int, history long, word long, n long, seen long, p double, lower double")
        stored = mine if stored is None else stored.unionByName(mine)
        weights = cut(met.applyInArrow(summing(m), SUMS).groupBy("bucket").applyInArrow(weigh, "block long, at binary, payload binary"), "weights")
        told = told.unionByName(weights.select("block", F.lit(None).cast("int").alias("bucket"), F.lit(m + 2).alias("level"), "payload", F.lit("weight").alias("kind"), "at"))
    kind = docs.schema[key].dataType

    @trimmed
    def judge(row_: pa.Table, answer: pa.Table) -> pa.Table:
        row = row_.to_pylist()[0]
        block, grams, counts, _, alone, p = numbers(row, answer, order - 1)
        climb(grams, counts, alone, p, answer, order - 1)
        places, of_words = [g.place for g in grams], counts[0]
        del grams, counts, _, alone
        logs = np.log10(p[0])[block.seq]
        for place, x in zip(places, p[1:]):
            np.copyto(logs, np.log10(x)[place], where=place >= 0)
        c = of_words[block.seq]
        base = np.log10((c + 1) / (total + distinct + 1))
        first = block.ends - block.lengths
        each = lambda x: np.add.reduceat(x, first)
        return pa.table({key: pa.array(row["keys"], to_arrow_type(kind)), "trained": pa.array(row["flags"], pa.bool_()), "n_tokens": block.lengths, "n_known": each((c > 0).astype(np.int64)),
                         "train_tokens": np.full(len(first), total, np.int64), "base_score": each(base), "score": each(logs)})

    scored = blocks.select("keys", *whole).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        judge, f"`{key}` {kind.simpleString()}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored, stored
