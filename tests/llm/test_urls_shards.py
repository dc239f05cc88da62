"""URL filters and shards."""

from __future__ import annotations

import collections
import itertools
import zlib

import numpy as np
import pytest
from llm.conftest import ODD
from pyspark.sql import functions as F

from pagegrain.llm import shards, urls
from pagegrain.llm.queries import QUERIES, RULES


def test_parts_of_odd_urls(spark):
    rows = [("HTTP://Www.A.Org/Fr/x?Y#z", "www.a.org", "/Fr/x"), ("x://h", "h", ""), ("a://b?c=/d", "b", ""), ("//no", "", ""), (None, "", ""), ("", "", ""), ("s://u@h:80/p#f", "u@h:80", "/p"), ("a://b://c/d", "b:", "//c/d")]
    got = spark.createDataFrame(rows, "u string, h string, p string").select("h", "p", urls.host(F.col("u")).alias("gh"), urls.path(F.col("u")).alias("gp"), "u").collect()
    assert [(r.gh, r.gp) for r in got] == [(r[1], r[2]) for r in rows]


def test_rules_and_list(spark):
    pages = [(1, "http://x.example.net/en/a"), (2, "http://x.example.net/de/a"), (3, "http://example.net"), (4, "http://notexample.com/de/"), (5, "http://a.example.com/de/q"), (6, "http://b.org/fr/"), (7, "http://b.org/xx"),
             (8, "http://listed.com/p/?utm_source=q&b=2&a=1#f"), (9, "http://www.LISTED.com/p.html?a=1&b=2"), (10, "http://listed.com/P"), (11, None), (8, "http://listed.com/p/?utm_source=q&b=2&a=1#f")]
    df = spark.createDataFrame([(*p, "mine", "h") for p in pages], "page_id long, url string, verdict string, host string")
    listed = spark.createDataFrame([("https://listed.com/p?b=2&a=1",), (None,), ("https://listed.com/p?b=2&a=1",), ("nothing",)], "u string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, listed, RULES).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("example.com/de/", "block"), 6: ("org/fr/", "allow"), 7: (None, "allow"),
                   8: (None, "block"), 9: (None, "block"), 10: (None, "allow"), 11: (None, "allow")}
    assert urls.judge(df, listed, RULES).count() == len(pages)
    none = urls.judge(df, listed.where("false"), RULES)
    assert {r.verdict for r in none.where("page_id >= 8").collect()} == {"allow"} and urls.judge(df.where("false"), listed, RULES).count() == 0


def test_clashing_columns_stay(spark):
    names = ["w0", "W7", "block", "block__", "__hit", "__canonical", "__listed", "__url_hit", "rule"]
    df = spark.createDataFrame([(1, "http://a.com/x", *names), (2, "http://b.com/", *names)], ["page_id", "url", *names])
    got = urls.judge(df, df.where("page_id = 1").select("url"), RULES).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "allow"] and all(r[n] == n for r in got for n in names[:-1]) and got[0].rule is None


@pytest.mark.parametrize("blocks", [1, 3])
def test_full_filter_still_gives_exact_results(spark, monkeypatch, blocks):
    monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
    df = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), "id").alias("url"))
    got = urls.judge(df, df.where("page_id % 2 = 0").select("url"), [])
    assert got.where((F.col("verdict") == "block") != (F.col("page_id") % 2 == 0)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op3_url_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = shards.hilbert(list(cells.T), bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_of_the_table(spark, sf, texts):
    rows = QUERIES["op4_hilbert_shards"](spark, sf).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts.items()}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    order = [r.curve for k in sorted(by) for r in sorted(by[k], key=lambda r: r.slot)]
    assert order == sorted(order)


def test_odd_rows_and_files(spark, docs_of, tmp_path):
    df = docs_of(ODD).withColumn("curve", F.lit("mine"))
    got = shards.assign(df, ["lang", "n_chars"], ["doc_id"], 5, ["doc_id"]).collect()
    assert len(got) == len(ODD) and max(np.bincount([r.shard for r in got])) - min(np.bincount([r.shard for r in got])) <= 1
    few = shards.assign(df.limit(2), ["lang"], ["doc_id"], 8, ["doc_id"]).collect()
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2
    assert shards.assign(df.where("false"), ["lang"], ["doc_id"], 8, ["doc_id"]).collect() == []
    plain = docs_of(ODD)
    shards.write(plain, ["lang", "n_chars"], ["doc_id"], 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.where("doc_id is not null and text is not null").collect()) == sorted((k, t) for k, t in ODD if k is not None and t is not None)


@pytest.mark.parametrize("prefix", ["https://site", "s"])
def test_whole_values_make_levels(spark, prefix):
    rows = [(i, f"{prefix}{i % 16:02d}.org") for i in range(320)] + [(k, f"{prefix}03.org") for k in range(320, 480)] + [(480, None), (481, "")]
    df = spark.createDataFrame(rows, "doc_id int, source string")
    got = df.select("doc_id", "source", shards.levels(df, ["source"])[0].alias("level")).collect()
    named = sorted((x, n) for x, n in collections.Counter(s for _, s in rows if s is not None).items())
    want, at, total = {None: 0}, 0, sum(n for _, n in named)
    for x, n in named:
        want[x] = (2 * at + n) * 32 // (2 * total)
        at += n
    assert all(r.level == want[r.source] for r in got) and len(set(want.values())) >= 15
    raw = df.select("doc_id", F.col("source").cast("binary").alias("source"))
    again = raw.select("doc_id", shards.levels(raw, ["source"])[0].alias("level")).collect()
    assert {r.doc_id: r.level for r in again} == {r.doc_id: r.level for r in got}
