"""Lists page by page, and search over groups."""

from __future__ import annotations

import pytest
from conftest import DATA

from dealmill.domain import Domain
from dealmill.operators.listing import Group, Listing, grouped_search
from dealmill.plans import lists


def walk(listing: Listing, limit: int, **asked):
    seen, behind = [], None
    for _ in range(200):
        page = sorted(listing.page(limit, behind, **asked).collect(), key=lambda r: tuple(r[k] for k in listing.keys))
        assert len(page) <= limit and len({r.has_more for r in page}) <= 1
        seen += page
        if not page or not page[0].has_more:
            return seen
        behind = [page[-1][k] for k in listing.keys]
    raise AssertionError("no end")


def test_pages_hold_every_row_once_with_repeated_leading_keys(spark):
    rows = [(a, b, f"t{a}{b}") for a in range(3) for b in range(7)]
    made = Listing(spark.createDataFrame(rows, "a int, b bigint, t string").repartition(4), ("a", "b"))
    for limit in (1, 4, 7, 21, 50):
        assert [(r.a, r.b, r.t) for r in walk(made, limit)] == rows


def test_pages_of_terms_with_filters(spark, duck):
    got = walk(lists.terms(Domain(spark, DATA)), 100, kind="R", min_amount=60000.0, deal_id=None)
    want = duck.execute("SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_extendedprice >= 60000").fetchone()[0]
    assert len(got) == want > 100
    assert all(r.kind == "R" and r.amount >= 60000 for r in got)


def test_last_page_empty_page_and_wrong_requests(spark):
    made = lists.companies(Domain(spark, DATA))
    assert made.page(10, [10**9]).count() == 0
    assert made.page(10, query="no such name").count() == 0
    for wrong in (lambda: made.page(0), lambda: made.page(101), lambda: made.page(5, [1, 2]), lambda: made.page(5, colour="red")):
        with pytest.raises(ValueError):
            wrong()


def test_filters_over_links(spark, duck):
    got = {r.deal_id for r in walk(lists.deals(Domain(spark, DATA)), 50, company="S3", asset_id=None)}
    assert got == {r[0] for r in duck.execute("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 3").fetchall()}


def test_a_place_and_the_columns_reach_the_scan(spark):
    plan = lists.documents(Domain(spark, DATA)).page(5, [20], lang="en")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan and "text:string" not in plan and "TakeOrderedAndProject" in plan


def test_groups_order_grants_and_empty_groups(spark):
    names = spark.createDataFrame([(1, "Ring"), (2, "ringlet"), (3, "a ring"), (4, "ring"), (5, None), (6, "other")], "id int, name string")
    other = spark.createDataFrame([(1, "x", "RING"), (2, "y", None)], "id int, name string, alias string")
    groups = {"a": Group(names, "open"), "b": Group(other, "open", ("alias",)), "c": Group(names, "closed"), "d": Group(names.where("id = 6"), "open")}
    out = grouped_search(spark, groups, "Ring", ("open",), 3)
    got = sorted(((r.dataset, r.place, r.id, r.granted, r.returned) for r in out.collect()), key=str)
    assert got == sorted([("a", 1, "1", True, 3), ("a", 2, "4", True, 3), ("a", 3, "2", True, 3), ("b", 1, "1", True, 1), ("c", None, None, False, 0), ("d", None, None, True, 0)], key=str)
    assert grouped_search(spark, groups, "ring", (), 3).where("returned = 0 AND NOT granted").count() == 4
    with pytest.raises(ValueError):
        grouped_search(spark, groups, "  ", ("open",))


def test_datasets_without_grant_are_not_read(spark):
    d = Domain(spark, DATA)
    plan = grouped_search(spark, lists.groups(d), "ri", ("public",))._jdf.queryExecution().optimizedPlan().toString()
    assert "c_name" not in plan and "o_orderkey" not in plan and "p_type" in plan
