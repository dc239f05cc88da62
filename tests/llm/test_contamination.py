"""Decontamination against a plain search of windows."""

from __future__ import annotations

import random
import re

from hypothesis import given
from hypothesis import strategies as st
from llm.conftest import ODD
from pyspark.sql import functions as F

from pagegrain.llm import contamination as c

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return _WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))


def brute(docs, bench):
    wins = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k:k + 13]), set()).add(i)
    out = []
    for k, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= ids
        out.append((k, len(w), len(hit), sorted(str(i) for i in items if i is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def found(spark, docs, bench, **kw):
    f = c.find(docs, spark.createDataFrame(bench, "item_id long, text string"), "out", **kw)
    col = F.col("out")
    rows = f.select("doc_id", col["n_words"].alias("a"), c.n_hit(col).alias("b"), col["items"].alias("i"), c.contaminated(col).alias("z"), col["chars"].alias("chars"), "text").collect()
    return sorted(((r.doc_id, r.a, r.b, r.i, r.z) for r in rows), key=repr), rows


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["", "1", "é"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 13, 14, 30])))) for i in range(12)] + [(3, "same id twice"), (None, "no id here"), (50, None)]
    docs = []
    for k in range(30):
        parts = [" ".join(word() for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(bench)[1] or "").split()
            parts.append(", ".join(w[rng.randrange(3):]).upper())
        docs.append((k, " - ".join(parts)))
    return docs + ODD, bench


def test_against_plain_search(spark, docs_of):
    docs, bench = corpus()
    got, rows = found(spark, docs_of(docs), bench)
    assert got == brute(docs, bench)
    for r in rows:
        for a, b in zip(r.chars[::2], r.chars[1::2]):
            assert words(r.text[a:b]) and words(r.text[:a]) + words(r.text[a:b]) + words(r.text[b:]) == words(r.text)


def test_slices_give_the_same(spark, docs_of):
    docs, bench = corpus()
    assert found(spark, docs_of(docs), bench, slice_bytes=150)[0] == brute(docs, bench)


def test_empty_tables(spark, docs_of):
    assert found(spark, docs_of([(1, "a b")]), [])[0] == [(1, 2, 0, [], False)]
    assert found(spark, docs_of([]).where("false"), [(1, "a")])[0] == []


def test_clean_keeps_columns(spark, docs_of):
    df = docs_of([(1, "one two three"), (2, "x " * 100 + "one two three"), (3, None)])
    kept = c.clean(df, spark.createDataFrame([(1, "two three")], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


@given(st.text(max_size=60))
def test_words(text):
    assert [w.decode() for w in c.normal_words(text.encode("utf-8", "surrogatepass"))] == words(text) if not any("\ud800" <= x <= "\udfff" for x in text) else True
