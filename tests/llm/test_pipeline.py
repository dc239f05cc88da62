"""The pipeline: shape of the stages, columns between them, and planted documents."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pagegrain.llm.common import cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies, near copies, benchmark passages, junk and clean ones."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["tha", "ner", "ing", "or", "es", "tion"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(15)) for _ in range(n))
    passage = " ".join(word() for _ in range(40))
    first, long = text(4), " ".join(word() for _ in range(200)).split(" ")
    near = [*long]
    near[50] = "changed"
    broken = "\n".join(" ".join(long[i:i + 4]) for i in range(0, 200, 4))
    rows = [(0, first), (1, first), (2, text(4)), (3, " ".join(long)), (4, broken), (5, "12 34 !!"), (6, None), (7, f"{text(1)} {passage}"), (8, text(30) + " " + " ".join(passage.split()[:12])), (9, text(6) + "\n" + first.split("\n")[0])]
    path = tmp_path_factory.mktemp("pipeline")
    lang = [(k, t, "en", "s", len(t or "")) for k, t in rows] + [(100 + i, text(3), "en", "s", 0) for i in range(40)]
    spark.createDataFrame(lang, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, folder), name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns or name == "byte_bpe"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    assert {0, 1, 2, 3, 4, 7, 8, 9} <= seen["language_id"] and not {5, 6} & seen["language_id"]
    assert 1 not in seen["line_dedup"] and {0, 2, 3, 4, 7, 8, 9} <= seen["line_dedup"]
    assert seen["line_dedup"] - seen["near_duplicates"] == {4}
    assert seen["near_duplicates"] - seen["decontamination"] == {7}
    assert {k for k in seen["decontamination"] if k >= 100} == set(range(100, 140))
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.collect()} == seen["byte_bpe"] and whole.where(F.col("n_tokens") == 0).count() == 0
