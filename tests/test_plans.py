"""Properties of physical plans: what reaches the scan, which joins and limits are chosen."""

from __future__ import annotations

import re

import pytest
from conftest import DATA

from dealmill.plans import QUERIES


def plan(spark, name: str) -> str:
    df = QUERIES[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_date_range")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", text)


@pytest.mark.parametrize("name", ["join_interval_nearest", "fuzzy_name_pairs", "graph_industry_network", "join_semi_anti", "filter_related", "competitive_peers", "advanced_deal_search"])
def test_no_product_of_large_sides(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert not re.search(r"BroadcastNestedLoopJoin .*(LeftSemi|LeftAnti|LeftOuter)", text)


@pytest.mark.parametrize("name", ["window_recent_five", "join_lateral_top", "window_stratified_sample", "search_best_per_source", "latest_status"])
def test_rows_per_key_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["top_deals", "vector_top", "page_offset", "valuations_by_indication"])
def test_top_k_keeps_k_rows_a_task(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


#: Queries that leave the JVM for character references and for places in a text.
PARSERS = ("page_text", "cited_trials", "cleaned_contracts")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream_", "sync_")) and n not in PARSERS])
def test_no_python_in_relational_plans(spark, name):
    assert not re.search(r"Python|Pandas|MapInArrow", plan(spark, name))
