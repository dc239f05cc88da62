"""Texts stay where they are when their type is looked up."""

from __future__ import annotations

import pytest

from pagegrain.plans.registry import load_all


@pytest.mark.parametrize("name", ["txt29_prompts", "jn10_typed_documents", "set3_field_lists", "jn11_checkpoint_questions"])
def test_texts_are_not_dealt_by_type(spark, sf, name):
    plan = load_all()[name].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
