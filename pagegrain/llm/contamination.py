"""Benchmark decontamination: one automaton over the windows of the test items, texts scanned once.

A text and an item are their words: runs of digits, letters a-z (A-Z count as
those) and characters beyond ASCII. The windows of an item are its runs of 13
words; a shorter item is one window. The automaton reads word numbers, so an
occurrence is a range of word positions, which is mapped to character offsets of
the original text for texts that have one.

The benchmark is read in slices of about ``SLICE_BYTES`` (an item is never split),
each with its own automaton and its own pass over the texts. Between passes what
was found is written next to the texts in the shared folder, so one slice at a time
is on the driver, in a plan and in a worker, however large the benchmark.

Null and empty texts have no words and no hits. An item without words has no
windows. Items with a null id mark words but are not listed; rows with equal ids
are one item. Equal documents each give a row. An empty benchmark finds nothing.
Results come as one struct column, so no column of the input can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import cut

WINDOW = 13
SLICE_BYTES = 32 << 20

#: Bytes of a text to bytes of its words and spaces.
_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

FOUND = "struct<n_words: bigint, words: array<int>, chars: array<int>, items: array<string>>"


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def windows(items: list[tuple], size: int) -> dict[tuple[bytes, ...], set]:
    """window -> ids of the items that hold it."""
    out: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        ws = normal_words(text)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            out.setdefault(tuple(ws[i:i + size]), set()).add(item)
    return out


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(items: list[tuple], size: int):
    """A column function text -> ``FOUND``; ``words`` and ``chars`` hold starts and ends in turn."""

    class Known(dict):
        def __missing__(self, word):
            return 0

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers, trie = Known(), ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in windows(items, size).items():
            trie.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in window), (len(window), ids))
        if len(trie):
            trie.make_automaton()
        kind = pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                ws = normal_words(text)
                ranges, found = [], set()
                if len(trie) and ws:
                    for last, (n, ids) in trie.iter(tuple(map(numbers.__getitem__, ws))):
                        ranges.append((last - n + 1, last + 1))
                        found |= ids
                ranges = joined(ranges)
                chars = []
                if ranges:
                    at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
                    chars = [x for a, b in ranges for x in (at[a][0], at[b - 1][1])]
                rows.append((len(ws), [x for r in ranges for x in r], chars, sorted(i for i in found if i is not None)))
            yield pa.array([dict(zip(("n_words", "words", "chars", "items"), r)) for r in rows], kind)

    return scan


def _merged(before: Column, now: Column) -> Column:
    """Both findings of a text as one."""

    @F.arrow_udf("array<int>")
    def union(ranges: pa.Array) -> pa.Array:
        return pa.array([[x for r in joined(list(zip(v[::2], v[1::2]))) for x in r] for v in ranges.to_pylist()], pa.list_(pa.int32()))

    both = lambda name: F.concat(before[name], now[name])
    return F.struct(now["n_words"].alias("n_words"), union(both("words")).alias("words"), union(both("chars")).alias("chars"),
                    F.array_sort(F.array_distinct(both("items"))).alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, out: str, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with the struct ``out``: n_words, words and chars (starts and ends of the hit ranges), items (ids as strings, sorted)."""
    tests = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // slice_bytes) or 1
    for k in range(slices):
        here = tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == k).distinct() if slices > 1 else tests.distinct()
        now = _scan([(r.id, bytes(r.text)) for r in here.collect()], window)(F.col(text).cast("binary"))
        docs = docs.withColumn(out, _merged(F.col(out), now) if k else now)
        if k < slices - 1:
            docs = cut(docs, f"benchmark-{k}")
    return docs


def n_hit(found: Column) -> Column:
    """Words inside any occurrence."""
    return F.aggregate(F.transform(found["words"], lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("bigint")


def contaminated(found: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit(found) > 0) & (n_hit(found) * 20 >= found["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    flag = "__found"
    while flag in docs.columns:
        flag += "_"
    return find(docs, benchmark, flag).where(~contaminated(F.col(flag))).drop(flag)
