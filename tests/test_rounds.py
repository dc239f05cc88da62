"""Overlap removal in rounds against the fold over a document, one region at a time."""

from __future__ import annotations

import random

from pagegrain.operators import spatial

SCHEMA = "doc_id long, ord long, x1 double, y1 double, x2 double, y2 double, content string"


def fold(rows, limit=0.7):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        def repeats(k):
            w, h = min(k[4], r[4]) - max(k[2], r[2]), min(k[5], r[5]) - max(k[3], r[3])
            small = min((k[4] - k[2]) * (k[5] - k[3]), (r[4] - r[2]) * (r[5] - r[3]))
            return k[0] == r[0] and w > 0 and h > 0 and small > 0 and w * h / small > limit and (r[6] == k[6] or r[6] == "")
        if not any(map(repeats, kept)):
            kept.append(r)
    return sorted((r[0], r[1]) for r in kept)


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.doc_id, r.ord) for r in spatial.kept_region_rows(frame, **options).collect())


def test_equals_the_fold_on_random_regions(spark):
    rng = random.Random(5)
    rows = []
    for d in range(6):
        for i in range(60):
            x, y = rng.choice([0.0, 3.0, 7.0, 900.0, 1020.0]), rng.choice([0.0, 2.0, 4.0, 250.0, 255.0])
            rows.append((d, i, x, y, x + rng.choice([0.0, 10.0, 11.0, 30.0]), y + rng.choice([10.0, 12.0]), rng.choice(["", "a", "b"])))
    assert got(spark, rows, tile=(64.0, 16.0)) == fold(rows)


def test_chains_and_many_equal_regions(spark):
    chain = [(1, i, 0.0, float(i), 10.0, i + 6.0, "a") for i in range(9)]
    equal = [(2, i, 5.0, 5.0, 9.0, 9.0, "same") for i in range(3000)] + [(2, 3000, 5.0, 5.0, 9.0, 9.0, ""), (2, 3001, 5.0, 5.0, 9.0, 9.0, "other")]
    flat = [(3, 0, 1.0, 1.0, 1.0, 4.0, "a"), (3, 1, 1.0, 1.0, 1.0, 4.0, "a")]
    assert got(spark, chain + equal + flat) == fold(chain + equal + flat)
    assert len([r for r in fold(chain)]) not in (1, 9)


def test_nothing_to_remove(spark):
    assert got(spark, []) == [] and got(spark, [(1, 0, 0.0, 0.0, 5.0, 5.0, "a")]) == [(1, 0)]
