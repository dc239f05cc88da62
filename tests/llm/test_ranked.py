"""Ranked search against a plain scoring of every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from llm.conftest import ODD

from pagegrain.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    held = [b for _, b in bags if b]
    n_docs, n_terms = len(held), sum(sum(b.values()) for b in held)
    df = Counter(t for b in held for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("block,postings,slices", [(8192, 2_000_000, 8 << 20), (64, 2_000_000, 8 << 20), (64, 900, 2000)])
def test_equals_brute_force_whatever_the_blocks(spark, texts, con, docs_of, monkeypatch, block, postings, slices):
    monkeypatch.setattr(ranked, "ROUND", 4)
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()[:12]
    docs = list(texts.items())
    frame = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    found = ranked.search(docs_of(docs).repartition(3), frame, block=block, postings=postings, slice_bytes=slices)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(docs, items)


def test_odd_rows_ties_and_repeats(spark, docs_of):
    items = [("a", "A word, déjà 345 a"), ("b", None), ("c", ""), ("d", "?!"), ("a", "A word, déjà 345 a"), (None, "word ab"), ("e", "absent"), ("f", "x y")]
    docs = [*ODD, *[(100 + i, "x y") for i in range(30)], (50, "y x"), (100, "x y")]
    found = ranked.search(docs_of(docs), spark.createDataFrame(items, "item_id string, text string"))
    assert got(found) == brute(docs, [i for i in items if i[1]])
    assert [r.doc_id for r in found.where("item_id = 'f'").orderBy("rank").collect()] == [50, 100, 100, *range(101, 108)]


def test_more_terms_than_a_mask_word_holds(spark, docs_of):
    words = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(w for j, w in enumerate(words) if (i * 7 + j * j) % (3 + i % 5) == 0)) for i in range(200)]
    items = [(1, " ".join(words)), (2, " ".join(words[::2] + words[:9]))]
    assert got(ranked.search(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), block=32)) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got(ranked.search(docs_of([]), item)) == []
    assert got(ranked.search(docs_of([(1, "a")]), item.where("false"))) == []
    assert got(ranked.search(docs_of([(1, None), (2, "")]), item)) == []


def test_groups_below_the_threshold_are_not_scored(spark, docs_of, monkeypatch):
    """Documents of one mask are one group; weak groups stay unscored."""
    import numpy as np
    post = ranked._posted({b"a": 0, b"b": 1, b"c": 2}, 1024, 10**6)
    import pyarrow as pa
    texts = ["a b c"] * 20 + ["c"] * 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(520)), pa.array([t.encode() for t in texts])], names=["id", "text"])
    row = next(post([batch])).to_pylist()[0]
    block = ranked.Block(row, 1024, 520, sum(len(t.split()) for t in texts))
    item = [(0, 3000), (1, 3000), (2, 10)]
    at, starts, bounds = block.groups(item)
    assert len(starts) == 2 and len(at) == 520 and np.isin(at[starts[np.argmax(bounds)]], range(20))
    scored = []
    plain = block.scores
    monkeypatch.setattr(block, "scores", lambda item, at: scored.append(len(at)) or plain(item, at))
    monkeypatch.setattr(ranked, "ROUND", 1)
    top = ranked.Best(10)
    block.best(item, top)
    assert scored == [20] and top.rows[1].tolist() == list(range(10))
