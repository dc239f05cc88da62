"""The n-gram join against all pairs, on texts made of copies, near copies and shared passages."""

from __future__ import annotations

import random

import pytest
from llm.conftest import ODD

from pagegrain.llm import jaccard

_LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    def shingles(t):
        w = [x for x in (t or "").translate(_LOWER).encode().split()]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets = [(k, shingles(t)) for k, t in rows]
    label = {k: k for k, _ in sets}
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1:] if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(((k, len(s), label[k]) for k, s in sets), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    passage, rows, k = [word() for _ in range(60)], [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            rows.append((k, " ".join(w).upper() if k % 5 == 0 else "\n".join(w)))
            k += 3
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(docs_of, seed):
    rows = corpus(seed)
    assert found(docs_of(rows).repartition(5)) == brute(rows)


def test_split_columns(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 2)
    monkeypatch.setattr(jaccard, "CHAINED", 2)
    rows = corpus(3)
    assert found(docs_of(rows).repartition(4)) == brute(rows)


def test_odd_texts(docs_of):
    assert found(docs_of(ODD)) == brute(ODD)


def test_empty_table(docs_of):
    assert jaccard.join(docs_of([]).where("false")).collect() == []


def test_one_of_each(docs_of):
    rows = corpus(4)
    df = docs_of(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({label for _, _, label in brute(rows)})
