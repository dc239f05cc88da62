from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagegrain.llm.components import components


def brute(edges):
    label = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-5, 30), st.integers(-5, 30)), max_size=40))
def test_any_links(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == brute(edges)


def test_chain_nulls_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(None, 1), (100, 100), (200, None), (300, 301), (300, 301)]
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()} == brute(edges)
