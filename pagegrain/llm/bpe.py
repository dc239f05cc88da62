"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens keep their positions as number sequences in blocks (``blocks``); the
distinct pre-tokens of every block are dealt by word hash, so each is encoded
once in the corpus; ids return to the blocks, where every text is put together
by position. Decoding looks ids up in the table of token bytes, whose size is
fixed by the vocabulary file.

Nulls count as empty texts and give no ids. Equal rows each give a row. Rows
with a null key stay. An empty table gives an empty result. Only the key and the
results are returned, so other columns can have any name.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagegrain.llm.blocks import buckets_for, by_bucket, dealt, spans, token_blocks
from pagegrain.llm.common import packed, trim, unpacked, unpacked_words

#: Unicode white space, written out: ``re`` counts four control characters too many.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: White space always begins a token, so a text may be cut before it and the pieces tokenized apart.
ASCII_WHITE = b" \t\n\x0b\x0c\r"
UNSURE = (b"  ", *(x for w in b"\t\n\x0b\x0c\r" for x in (bytes((32, w)), bytes((w, 32)))), *(c.encode()[:2] for c in map(chr, (0x85, 0xA0, 0x1680, 0x2000, 0x205F, 0x3000))))
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a rank file: lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is joined, leftmost first, until no pair is a token."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n < 48:
        parts = [word[i:i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # long words: pairs wait in a heap; a pair whose ends have changed since is skipped
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>: the tokens of every text in order. ``pattern`` cuts pre-tokens and starts them at white space as ``PIECES`` does."""
    spark = docs.sparkSession
    shared, finer = spark.sparkContext.broadcast(ranks), regex.compile(pattern)

    def pieces(t: bytes | None) -> list:
        """Cut at spaces alone where no other white space touches one; the first piece, which has no space before it, is a tuple."""
        if not t:
            return []
        if t[0] in ASCII_WHITE or t[-1] in ASCII_WHITE or any(x in t for x in UNSURE):
            return PIECES.findall(t.decode("utf-8", "replace"))
        ws = t.split(b" ")
        ws[0] = (ws[0],)
        return ws

    def refine(piece) -> list[bytes]:
        whole = piece if isinstance(piece, str) else piece[0].decode("utf-8", "replace") if isinstance(piece, tuple) else f" {piece.decode('utf-8', 'replace')}"
        return [w.encode() for w in finer.findall(whole)]

    buckets = buckets_for(docs)
    blocks = token_blocks(docs, key, text, pieces, refine=refine)

    def encode_bucket(table: pa.Table) -> pa.Table:
        known: dict[bytes, list[int]] = {}
        lengths, ids = [], []
        for payload in table.column("words").to_pylist():
            found = []
            for w in unpacked_words(payload):
                got = known.get(w)
                if got is None:
                    got = known[w] = merged(w, shared.value)
                found.append(got)
            lengths.append(packed(np.fromiter(map(len, found), np.uint32, len(found))))
            ids.append(packed(np.fromiter((i for f in found for i in f), np.uint32)))
        trim()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "lengths": pa.array(lengths, pa.binary()), "ids": pa.array(ids, pa.binary())})

    coded = dealt(blocks, buckets).groupBy("bucket").applyInArrow(encode_bucket, "block long, bucket int, lengths binary, ids binary")
    kind = docs.schema[key].dataType

    def reassemble(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = sorted(zip(*[answers.column(c).to_pylist() for c in ("bucket", "lengths", "ids")]))
        none = np.zeros(0, np.uint32)
        lengths = np.concatenate([*(unpacked(r[1], np.uint32) for r in rows), none]).astype(np.int64)
        flat = np.concatenate([*(unpacked(r[2], np.uint32) for r in rows), none]).astype(np.int32)
        seq, ends = unpacked(block.column("seq")[0].as_py(), np.int32), unpacked(block.column("ends")[0].as_py(), np.int64)
        order, _ = by_bucket(unpacked_words(block.column("words")[0].as_py()), buckets)
        by_word, start = np.empty_like(lengths), np.empty_like(lengths)
        by_word[order], start[order] = lengths, np.cumsum(lengths) - lengths
        out, to = spans(flat, start, by_word, seq)
        offsets = np.concatenate(([0], np.concatenate(([0], to))[ends]))
        keys = pa.array(block.column("keys")[0].as_py(), to_arrow_type(kind))
        trim()
        return pa.table({key: keys, "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.int32()))})

    return (blocks.select("block", "keys", "ends", "seq", "words").groupBy("block")
            .cogroup(coded.groupBy("block")).applyInArrow(reassemble, f"`{key}` {kind.simpleString()}, ids array<int>"))


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``: the bytes of the tokens, side by side. Null ids give null; an id outside the table fails the job."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_id = dict(zip(shared.value.values(), shared.value))
        table = pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.binary())
        for a in batches:
            ids = a.flatten()
            known = not len(ids) or not ids.null_count and 0 <= pc.min(ids).as_py() and pc.max(ids).as_py() < len(table)
            tokens = table.take(ids) if known else None
            if tokens is None or tokens.null_count:
                raise ValueError("an id is not in the token table")
            offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy()))).astype(np.int32)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), pa.scalar(b"", pa.binary()))
            yield pc.if_else(pc.is_null(a), pa.scalar(None, pa.binary()), text)
        trim()

    return rows.withColumn(out, joined(F.col(ids)))


def digests(rows: DataFrame, ids: Column, decoded: Column, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 of the decimal ids joined by a space, decoded_sha256."""
    return rows.select(F.col(key), F.size(ids).cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
