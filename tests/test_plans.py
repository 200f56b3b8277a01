"""What the plans must and must not hold."""

import pytest

from wareweave.plans import registry

SF = "/root/testdata/sf0.001"
#: The only queries with Python in their tasks: edit ratios and matrix products.
#: text_score, match_path, matched_second_stage and hash_fused have theirs before a checkpoint.
PYTHON = {"edit_ratio", "edit_join"}
PYTHON |= {"embedding_topk", "embedding_topk_all", "embedding_threshold", "embedding_index"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("Python" in text or "Arrow" in text) == (name in PYTHON)


def test_scans_read_only_what_is_used(spark):
    text = plan(registry.queries()["clean_name_basic"](spark, SF))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {"p_partkey", "p_name", "p_brand"}


def test_filters_reach_the_scan(spark):
    text = plan(registry.queries()["limit_preview"](spark, SF))
    assert "TakeOrderedAndProject" in text
    text = plan(registry.queries()["no_match_rows"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_suppkey)" in text or "IsNotNull(l_partkey)" in text


def test_compatibility_joins_need_no_product(spark):
    for name in ("price_band_free", "category_join", "category_classes", "name_search"):
        text = plan(registry.queries()[name](spark, SF))
        conditions = [line for line in text.splitlines() if "Join" in line]
        assert conditions and not any("product_id" in line.split("], [")[0] for line in conditions)
