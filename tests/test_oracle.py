"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest
from oracle_check import check, duck

from pagegrain.plans.registry import load_all

ENTRIES = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query_matches_sql(spark, con, sf, name):
    reason, rows, _ = check(spark, con, sf, name, ENTRIES[name])
    assert reason is None
    assert rows > 0 or name in {"jn11_checkpoint_questions"}
