"""Nearest neighbours: recall against brute force, ties, hot groups and vectors that take no part."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import nearest
from pagegrain.llm.queries import QUERIES


def brute(rows, k, every):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    return {int(q): [i for _, i in sorted((-s, int(i)) for s, i in zip((x * x[n]).sum(1), ids) if i != q)[:k]] for n, q in enumerate(ids) if q % every == 0}


def found(df, k):
    out = {}
    for r in nearest.search(df, F.col("id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_on_the_table(spark, sf, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    want, got = brute(rows, 20, 20), {}
    for r in QUERIES["op2_nearest"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    assert set(got) == set(want)
    vec = {i: np.array(v, np.float64) for i, v in rows}
    for q, rs in got.items():
        assert sorted(rs) == list(range(1, 21))
        assert all(abs(r.score - vec[q] @ vec[r.vec_id]) < 1e-9 for r in rs.values())
        order = [(-rs[i].score, rs[i].vec_id) for i in sorted(rs)]
        assert order == sorted(order) and q not in {r.vec_id for r in rs.values()}
    assert np.mean([len({r.vec_id for r in rs.values()} & set(want[q])) / 20 for q, rs in got.items()]) >= 0.9


@pytest.mark.parametrize("part", [2_048, 7])
def test_hot_group_and_ties(spark, monkeypatch, part):
    monkeypatch.setattr(nearest, "BIN_ROWS", part)
    monkeypatch.setattr(nearest, "BIN_QUERIES", 3)
    monkeypatch.setattr(nearest, "LEAF_ROWS", 30)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8)
    rows = [(i, (hot if i % 3 == 0 else rng.normal(size=8) * (1 + i % 5)).astype(np.float32).tolist()) for i in range(400)]
    want, got = brute(rows, 10, 20), found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10)
    assert np.mean([len(set(got[q]) & set(w)) / 10 for q, w in want.items()]) >= 0.9
    assert all(len(v) == 10 for v in got.values())


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 1.0]),
            (20, [-1.0, 0.5]), (20, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))
    assert found(df, 20) == {0: [6, 20], 20: [0, 6]}
    assert found(df.where("false"), 20) == {}
    assert found(df.where("vec_id = 0"), 20) == {}


def test_copies_do_not_lift_the_others(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 30)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=12)
    rows = [(i, (hot if i % 10 < 5 and i % 20 == 0 and i % 60 != 0 or i % 3 == 1 else rng.normal(size=12)).astype(np.float32).tolist()) for i in range(3_000)]
    copies = {i for i, v in rows if np.allclose(v, hot)}
    want, got = brute(rows, 10, 20), found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10)
    others = [q for q in want if q not in copies]
    assert len(others) >= 40 and len(want) - len(others) >= 90
    score = lambda q, i: float(np.dot(np.float64(rows[q][1]), np.float64(rows[i][1])))
    assert np.mean([sum(score(q, i) >= score(q, want[q][-1]) - 1e-9 for i in got[q]) / 10 for q in others]) >= 0.95
    assert nearest.RECALL == 0.97
