"""Documents of 200 000 lines: results by plain Python, within a stated time each."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from pagegrain.functions import markdown
from pagegrain.functions.arrays import scan
from pagegrain.operators import chunking, tables

N, SECONDS = 200_000, 90


def timed(frame):
    t = time.time()
    rows = frame.collect()
    assert time.time() - t < SECONDS
    return rows


@pytest.fixture(scope="module")
def lines():
    return [f"line {i} " + "x" * (i % 37) + ("." if i % 3 else "") for i in range(N)]


@pytest.fixture
def one_text(spark):
    return lambda text: spark.createDataFrame([(1, text)], "doc_id long, text string")


def packed(pieces, joiner, extra, size=500, minimum=50):
    out, cur, length = [], [], 0
    for p in pieces:
        if cur and length + len(p) + extra > size:
            out.append(joiner.join(cur))
            cur, length = [], 0
        length = len(p) if not cur else length + len(p) + len(joiner)
        cur.append(p)
    return [c for c in [*out, joiner.join(cur)] if len(c) >= minimum]


@pytest.mark.parametrize("strategy", ["paragraph", "mixed"])
def test_paragraph_packing(one_text, lines, strategy):
    rows = timed(chunking.chunks(one_text("\n\n".join(lines)), "doc_id", strategy=strategy).orderBy("idx"))
    if strategy == "paragraph":
        assert [r.content for r in rows] == packed([x.strip() for x in lines], "\n\n", 1)
    else:
        assert [r.content for r in rows] == packed([x.strip() for x in lines], "\n\n", 2)


def test_sentence_packing(one_text):
    text = "".join(f"Sentence {i} of many." for i in range(N))
    rows = timed(chunking.chunks(one_text(text), "doc_id", strategy="sentence").orderBy("idx"))
    assert [r.content for r in rows] == packed([f"Sentence {i} of many." for i in range(N)], "", 0)


def test_anchors_and_runs(one_text, lines):
    text = "\n".join(f"<!-- @block:b{i} {i},2,3,4 -->\n{x}" for i, x in enumerate(lines))
    row = timed(one_text(text).select(F.transform(markdown.parsed_anchors(F.col("text")), lambda a: a["position"]).alias("at"), F.size(markdown.markdown_runs(F.col("text"))).alias("runs")))[0]
    want, at = [], 0
    for i, x in enumerate(lines):
        want.append(at)
        at += len(f"<!-- @block:b{i} {i},2,3,4 -->\n{x}\n")
    assert list(row["at"]) == want and row["runs"] == 2 * N


def test_anchored_rows(spark):
    ys = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: (i * 3).cast("double"))
    ids = timed(spark.range(1).select(tables.anchored_rows(ys, 10.0).alias("ids")))[0]["ids"]
    assert list(ids) == [i // 4 for i in range(N)]


def test_scan_of_short_and_missing_arrays(spark):
    frame = spark.createDataFrame([(1, [3, 1, 2]), (2, []), (3, None), (4, list(range(100)))], "k int, xs array<int>")
    sums = scan(F.col("xs"), {"s": F.lit(0)}, lambda s, x: {"s": s["s"] + x, "emit": F.when(x != 1, s["s"] + x)}, "int")
    got = {r.k: r.s for r in frame.select("k", sums.alias("s")).collect()}
    assert got[1] == [3, 6] and got[2] == [] and got[3] is None and got[4] == [sum(range(i + 1)) for i in range(100) if i != 1]
