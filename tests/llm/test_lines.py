"""Line dedup against all pairs of lines."""

from __future__ import annotations

import random
import zlib  # noqa: F401

import pytest
from llm.conftest import ODD

from pagegrain.llm import lines


def brute(rows):
    """Kept text by row; rows of distinct keys in ascending order, null first."""
    seen, out = [], []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        kept = []
        for line in t.split("\n") if t is not None else []:
            s = frozenset(w for w in line.lower().replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w)
            if not s or not any(100 * len(s & e) >= 80 * len(s | e) for e in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out.append((k, None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "w%d" % int(rng.paretovariate(0.6) % 3000)
    pool = [[word() for _ in range(rng.choice([1, 2, 4, 5, 6, 12, 30]))] for _ in range(25)]
    rows = []
    for k in range(n):
        ls = []
        for _ in range(rng.randrange(6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            ls.append(" ".join(w) if rng.random() < 0.8 else "\t".join(w).upper())
        rows.append((k, "\n".join(ls)))
    return rows


def found(df):
    return sorted(((r.doc_id, r.text) for r in lines.dedup(df).collect()), key=repr)


@pytest.mark.parametrize("light", [2, 48])
def test_against_all_pairs(docs_of, monkeypatch, light):
    monkeypatch.setattr(lines, "LIGHT", light)
    rows = corpus(light)
    df = docs_of(rows)
    assert found(df) == brute(rows)
    assert lines.dedup(df).columns == df.columns


def test_odd_texts(docs_of):
    distinct = [r for r in dict.fromkeys(ODD)]
    assert found(docs_of(distinct)) == brute(distinct)


def test_equal_rows_keep_the_same_lines(docs_of):
    got = found(docs_of([(1, "a b c\nx"), (1, "a b c\nx"), (2, "x\ny")]))
    assert got == [(1, "a b c\nx"), (1, "a b c\nx"), (2, "y")]


def test_empty_table_and_wholly_repeated_documents(docs_of):
    assert lines.dedup(docs_of([]).where("false")).collect() == []
    kept = lines.kept(docs_of([(1, "one two\nthree"), (2, "three\none two"), (3, ""), (4, None), (5, " \nfour")]))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect() if r.text is not None) == [(1, "one two\nthree", 13), (3, "", 0), (5, " \nfour", 6)]
    assert 4 in {r.doc_id for r in kept.collect()}


def test_no_python_in_the_plan(docs_of):
    plan = lines.dedup(docs_of(corpus(5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_copies_are_compared_about_once_each(spark, monkeypatch):
    """Of 60 lines that are alike the first stays; 1770 pairs share words, few of them are compared."""
    words = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join([*words[:k % 40], f"new{k}", *words[k % 40 + 1:]])) for k in range(60)]
    docs, compared, verified = spark.createDataFrame(rows, "doc_id long, text string"), [], lines.verified

    def counted(d, key, text, pairs):
        compared.append(pairs.count())
        return verified(d, key, text, pairs)

    monkeypatch.setattr(lines, "verified", counted)
    got = lines.dedup(docs, lost="n").collect()
    assert sorted(r.doc_id for r in got if r.n) == list(range(1, 60))
    assert sum(compared) < 3 * 60


def long_lines(seed, n, pool, size, shared):
    """Lines of ``size`` words of a pool; of these, line k and its next one hold a word of their own in common."""
    rng = random.Random(seed)
    return [(k, " ".join([*(f"s{k + d}_{i}" for d in (0, 1) for i in range(shared)), *rng.sample([f"p{i}" for i in range(pool)], size - 2 * shared)])) for k in range(n)]


@pytest.mark.parametrize("light", [2, 48])
def test_long_lines_against_all_pairs(docs_of, monkeypatch, light):
    """Lines about as long as the longer parity map begins, and alike to about the limit."""
    monkeypatch.setattr(lines, "LIGHT", light)
    rng, rows = random.Random(7), []
    for k in range(60):
        base = [f"b{k % 6}_{i}" for i in range(rng.choice([90, 97, 110, 200, 320]))]
        new = [w if rng.random() < 0.9 else f"n{rng.randrange(400)}" for w in base]
        rows.append((k if k else None, " ".join(new)))
    assert found(docs_of(rows)) == brute(rows)


def test_long_lines_that_share_few_words_are_not_compared(spark, monkeypatch):
    """A map of 64 bits can't tell lines of 150 words apart."""
    rows = long_lines(3, 60, 1500, 150, 3)
    docs, compared, verified = spark.createDataFrame(rows, "doc_id long, text string"), [], lines.verified

    def counted(d, key, text, pairs):
        compared.append(pairs.count())
        return verified(d, key, text, pairs)

    monkeypatch.setattr(lines, "verified", counted)
    assert [r.n for r in lines.dedup(docs, lost="n").collect()] == [0] * 60
    assert sum(compared) < 10
