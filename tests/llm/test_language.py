"""Language identification: held-out accuracy, odd texts, and the sums themselves."""

from __future__ import annotations

import zlib

import numpy as np
from llm.conftest import ODD
from pyspark.sql import functions as F

from pagegrain.llm import language
from pagegrain.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf, con):
    truth = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op1_language_id"](spark, sf).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_and_columns(docs_of):
    df = docs_of([*ODD, (20, "der und die " * 5), (21, "12 ½ ² !"), (22, "the and of " * 5)]).withColumn("lang", F.when(F.col("doc_id") == 20, "de").when(F.col("doc_id") == 22, "en").when(F.col("doc_id") == 1, "fr"))
    model = language.fit(df, F.lit(True))
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r["out"] for r in language.predict(df, model, "out").collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 21)] == ["und"] * 4 and got[1].score == 0.0
    assert (got[20].lang_pred, got[22].lang_pred) == ("de", "en")
    kept = language.known(df, model)
    assert kept.columns == df.columns and {20, 22} <= {r.doc_id for r in kept.collect()} and not {1, 2, 3, 21} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(docs_of):
    df = docs_of([(1, "abc")])
    model = language.fit(df, F.lit(False))
    assert language.predict(df, model, "p").first().p.lang_pred == "und"
    assert language.predict(df.where("false"), model, "p").collect() == []


def test_backoff_and_forgetting():
    model = language.Model(["x", "y"], np.zeros(2), np.array([[-1.0, -2.0], [-3.0, -1.0], [-5.0, -4.0]]), {"known": 0}, {"<ab": 1, "b": 2})
    rows = language.Rows(model, bound=2)
    assert rows.of(["known"]).tolist() == [-1.0, -2.0]
    assert rows.of(["abz"]).tolist() == [-3.0, -1.0]  # the longest known length decides
    assert rows.of(["zzb"]).tolist() == [-5.0, -4.0]
    assert rows.of(["q"] * 2).tolist() == [0.0, 0.0]
    assert rows.of(["known", "abz", "u", "v", "w", "zzb"]).tolist() == [-9.0, -7.0]


def test_a_large_language_takes_no_place_of_a_small_one(docs_of):
    big = ["".join(chr(97 + i // 5 ** j % 5) for j in range(4)) for i in range(300)]
    rows = [(k, " ".join(big[(k * 30 + j) % 300] for j in range(60))) for k in range(100)] + [(k, "xyz zyx xzy") for k in range(100, 103)]
    df = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") < 100, "aa").otherwise("bb"))
    model = language.fit(df, F.lit(True), entries=40)
    assert {"xyz", "zyx", "xzy"} <= set(model.words) and len(model.words) == 43 and len(model.grams) <= 80
    got = language.predict(docs_of([(1, "xyz xzy"), (2, " ".join(big[:5]))]), model, "p").orderBy("doc_id").collect()
    assert [r.p.lang_pred for r in got] == ["bb", "aa"]


def test_the_fit_reads_the_whole_sample():
    assert (language.SAMPLE, language.ENTRIES) == (8_000, 120_000)


def test_the_model_is_held_as_hashes_and_words_of_the_texts_are_bounded():
    words = {f"wort{i}": i for i in range(5000)}
    index = language.Index.of(words)
    assert index.find(["wort7", "fremd", "wort4999", ""]).tolist() == [7, -1, 4999, -1] and sum(c.nbytes for c in index) == 20 * 5000
    assert language.Index.of({}).find(["x"]).tolist() == [-1]
    model = language.Model(["x", "y"], np.zeros(2), np.arange(10_000.0).reshape(-1, 2), index, {})
    rows = language.Rows(model, bound=8)
    for i in range(0, 5000, 4):
        assert rows.of([f"wort{i + j}" for j in range(4)] + ["fremd"]).tolist() == model.rows[i:i + 4].sum(0).tolist() and len(rows) <= 8
