"""Sentences against a pattern in plain Python, also where a text holds the mark that cuts it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagegrain.operators import chunking

ODD = ["", ".", "..a. b!!  c", "a\x00b. c\x00.d", "\x00..\x00x.", " . .. a 。b！？c；\n d?e", "no end", "x.\n\ny;;;z", "ä。ö.😀!b", " .", "é . ! b.."]


def by_pattern(text):
    ends = chunking.ENDINGS
    found = [(m.group(1), m.start(1)) for m in re.finditer(f"([^{ends}]+[{ends}]?)[{ends}]*", text)]
    return [(p.strip(), at + len(p) - len(p.lstrip())) for p, at in found if p.strip()]


def test_sentences_are_cut_without_patterns(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, *(t * 50 for t in ODD)]], "text string").select("text", chunking.sentences(F.col("text")).alias("s"))
    for r in df.collect():
        assert [tuple(x) for x in r["s"]] == by_pattern(r["text"])
    assert "extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
