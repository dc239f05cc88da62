"""Katz scores against counts in plain Python; the model adds up to one."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import ODD
from pyspark.sql import functions as F

from pagegrain.llm import katz, language
from pagegrain.llm.common import packed_words

START, END = "<s>", "</s>"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\x0b\x0c\r\n":
        low = low.replace(c, " ")
    return [*(w for w in low.split(" ") if w), END]


def model(train):
    uni, bi, hist = Counter(), Counter(), Counter()
    for ts in train:
        uni.update(ts)
        pairs = list(zip([START, *ts[:-1]], ts))
        bi.update(pairs)
        hist.update(a for a, _ in pairs)
    of = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    u, d = katz.Unigrams(sum(uni.values()), len(uni), of(uni)), katz.discounts(of(bi), 2)
    lower = lambda w: float(u.of(np.array([uni[w]]))[0])
    p = {k: float(katz.discounted(np.array([c]), d)[0]) / hist[k[0]] for k, c in bi.items() if c >= 2}
    mass, low = Counter(), Counter()
    for (a, w), x in p.items():
        mass[a] += x
        low[a] += lower(w)
    scale = {a: hist[a] / (hist[a] + 1) if mass[a] > 1 - 1e-9 else 1.0 for a in mass}
    weight = {a: (1 - scale[a] * mass[a]) / (1 - low[a]) for a in mass}
    prob = lambda a, w: scale[a] * p[a, w] if (a, w) in p else weight.get(a, 1.0) * lower(w)
    return uni, u, hist, prob


def check(df, rows, is_train):
    scored, stored = katz.score(df, F.col("doc_id").isNotNull() & (F.col("doc_id") % 5 != 2))
    uni, u, _, prob = model([tokens(t) for k, t in rows if is_train(k)])
    n, v = sum(uni.values()), len(uni)
    want = []
    for k, t in rows:
        ts = tokens(t)
        want.append((k, len(ts), sum(w in uni for w in ts), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ts), sum(math.log10(prob(a, w)) for a, w in zip([START, *ts[:-1]], ts))))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored.collect()]
    key = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    return stored


def test_against_plain_counts(docs_of):
    rng = random.Random(2)
    rows = [(k, " ".join("w%d" % int(rng.paretovariate(0.8) % 60) for _ in range(rng.randrange(60))).upper()) for k in range(60)] + ODD
    stored = check(docs_of(rows).repartition(4), rows, lambda k: k is not None and k % 5 != 2)
    assert stored.count() == stored.select("history", "word").distinct().count() and stored.where("n < 2").count() == 0


def test_every_history_adds_up_to_one():
    rng = random.Random(3)
    train = [tokens(" ".join("w%d" % int(rng.paretovariate(0.7) % 40) for _ in range(50))) for _ in range(40)] + [["only", "once", END], ["x", "y", END], ["x", "y", END]]
    uni, u, hist, prob = model(train)
    for a in [START, *uni, "unseen"]:
        assert sum(prob(a, w) for w in uni) + prob(a, "never seen") == pytest.approx(1.0)


def test_no_training_rows_and_empty_table(docs_of):
    scored, stored = katz.score(docs_of([(2, "a b")]), F.lit(False))
    r = scored.first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0) and stored.count() == 0
    assert katz.score(docs_of([]).where("false"), F.lit(True))[0].collect() == []


def test_held_out_texts_beat_the_base(spark, sf):
    from pagegrain.llm.queries import QUERIES
    got = QUERIES["op8_katz_scores"](spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_discounts_fall_back():
    assert katz.discounts([0] * 6).tolist() == [0, 1, 1, 1, 1, 1]
    d = katz.discounts([100, 40, 20, 12, 8, 6])
    assert d[0] == 0 and all(0 < x <= 1 for x in d[1:]) and language.UNKNOWN == "und" and zlib.crc32(b"") == 0


def whole_model(train, order):
    """Plain recursive Katz of all n-grams; no history reaches beyond the start."""
    at = lambda ts, i, m: tuple([START, *ts][max(0, i + 2 - m):i + 2])  # noqa: E731  the m-gram that ends at token i
    uni, grams, hist = Counter(w for ts in train for w in ts), {}, {}
    for m in range(2, order + 1):
        grams[m] = Counter(at(ts, i, m) for ts in train for i in range(m - 2, len(ts)))
        hist[m] = Counter()
        for g, c in grams[m].items():
            hist[m][g[:-1]] += c
    of = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    u, d = katz.Unigrams(sum(uni.values()), len(uni), of(uni)), {m: katz.discounts(of(c)) for m, c in grams.items()}
    after = {}
    for m, c in grams.items():
        for g in c:
            after.setdefault(g[:-1], []).append(g[-1])

    def kept(h, w):
        c = grams[len(h) + 1][*h, w]
        return (float(d[len(h) + 1][c]) if c <= katz.DISCOUNTED else 1.0) * c / hist[len(h) + 1][h]

    def prob(h, w):
        if not h:
            return float(u.of(np.array([uni[w]]))[0])
        if h not in after:
            return prob(h[1:], w)
        mass, n = sum(kept(h, x) for x in after[h]), hist[len(h) + 1][h]
        scale = n / (n + 1) if mass > 1 - 1e-9 else 1.0
        if w in after[h]:
            return scale * kept(h, w)
        return (1 - scale * mass) / (1 - sum(prob(h[1:], x) for x in after[h])) * prob(h[1:], w)

    return uni, grams, lambda ts, i: prob(at(ts, i, order)[:-1], ts[i]), prob


@pytest.mark.parametrize("order", [2, 3, 4])
def test_all_ngrams_of_higher_orders(docs_of, monkeypatch, order):
    monkeypatch.setattr(katz, "token_blocks", lambda *a, f=katz.token_blocks, **b: f(*a, **b, tokens=300))
    rng = random.Random(5)
    rows = [(k, " ".join("w%d" % int(rng.paretovariate(0.8) % 40) for _ in range(rng.randrange(40)))) for k in range(60)] + [(k, "ever the same line") for k in range(60, 80)] + ODD
    scored, stored = katz.score(docs_of(rows).repartition(3), F.coalesce(F.col("doc_id") % 5 != 2, F.lit(False)), order=order, least=1)
    uni, grams, p, prob = whole_model([tokens(t) for k, t in rows if k is not None and k % 5 != 2], order)
    want = sorted((str(k), len(ts := tokens(t)), sum(math.log10(p(ts, i)) for i in range(len(ts)))) for k, t in rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in scored.collect())
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)
    assert sorted((r.order, r.n) for r in stored.collect()) == sorted((m, c) for m, cs in grams.items() for c in cs.values())
    for g in [*grams[order]][:50]:
        assert sum(prob(g[:-1], w) for w in uni) + prob(g[:-1], "never seen") == pytest.approx(1.0)


def test_the_query_keeps_single_ngrams_and_trigrams(spark, sf, monkeypatch):
    from pagegrain.llm.queries import QUERIES
    kept = []
    monkeypatch.setattr(katz, "score", lambda *a, f=katz.score, **b: kept.append(f(*a, **b)) or kept[0])
    QUERIES["op8_katz_scores"](spark, sf)
    assert {r.order for r in kept[0][1].where("n = 1").select("order").distinct().collect()} == {2, 3}


def test_ngrams_of_one_block_are_weighed_there(spark, monkeypatch):
    """Two blocks without a common word have no common bigram, so no weight of a bigram travels."""
    rows = [(k, f"{w}a {w}b {w}c {w}a {w}b {w}d {w}{k}") for w, ks in (("x", range(0, 12)), ("y", range(12, 24))) for k in ks]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    weights, cut = [], katz.cut

    def kept(df, label):
        out = cut(df, label)
        if label == "weights":
            weights.append(out)
        return out

    monkeypatch.setattr(katz, "cut", kept)
    scored, _ = katz.score(docs, F.col("doc_id") % 5 != 2, order=3, least=1)
    _, _, p, _ = whole_model([tokens(t) for k, t in rows if k % 5 != 2], 3)
    for r in scored.collect():
        ts = tokens(rows[r.doc_id][1])
        assert r.score == pytest.approx(sum(math.log10(p(ts, i)) for i in range(len(ts))))
    assert len(weights) == 2 and weights[0].count() > 0 and weights[1].count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_order_of_hashes(n):
    """Also where hashes differ in bits that give way to the place."""
    rng = np.random.default_rng(n)
    for h in (rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 7, n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)):
        by = katz.order_of(h)
        assert sorted(by.tolist()) == list(range(n)) and h[by].tolist() == sorted(h.tolist())


def test_ngrams_of_a_block_take_few_bytes_a_token():
    """An executor holds two blocks of 2 million tokens beside the JVM."""
    n, rng = 1 << 19, np.random.default_rng(1)
    words, seq = [b"w%d" % i for i in range(5000)], rng.integers(0, 5000, n).astype(np.int32)
    block = katz.Block({"seq": katz.packed(seq), "ends": katz.packed(np.arange(1024, n + 1, 1024)), "words": packed_words(words), "flags": [True] * (n // 1024)})
    tracemalloc.start()
    grams = list(block.grams(3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int(g.n.sum()) for g in grams] == [n, n - n // 1024] and peak < 110 * n
