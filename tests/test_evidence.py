"""Criteria over child rows against a plain reading of the same rows, row by row."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from dealmill.domain import Domain
from dealmill.operators.evidence import Between, Child, Companies, During, Evidence, Named, satisfying, told_by
from dealmill.operators.filters import Dates, Scalar
from dealmill.plans.evidence import search

WORDS = (None, "", "Alpha", "beta", "alphabet", "GAMMA")


def rows_of(n=400):
    rng = random.Random(5)
    day = lambda: rng.choice([None, dt.datetime(2020, 1, rng.randint(1, 28), rng.randint(0, 23))])
    return [(rng.choice([None, *range(60)]), rng.choice(WORDS), rng.choice(WORDS), rng.choice(["x", "y", None]), rng.choice([None, 1.0, 2.0, 3.0]), day()) for _ in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    rows = rows_of()
    child = spark.createDataFrame(rows, "deal_id bigint, name string, alias string, role string, amount double, at timestamp_ntz")
    c = F.col
    found = (
        Evidence("asset", "deal", (c("name"),), c("name"), refinement=c("role")), Evidence("asset", "public", (c("alias"),)),
        Evidence("paid", "deal", number=c("amount"), where=c("role") == "x"), Evidence("event", "deal", at=c("at")),
    )
    facts = spark.createDataFrame([(i, i % 3) for i in range(70)], "deal_id bigint, at int")  # a clashing column, and deals without children
    return rows, facts, [Child(child, found)]


def has(text, value):
    return text is not None and value.lower() in text.lower()


CASES = [
    ([Named("asset", any=("alpha", "gam"))], lambda r: any(has(x[1], v) or has(x[2], v) for x in r for v in ("alpha", "gam"))),
    ([Named("asset", ("public",), all=("alpha", "beta"))], lambda r: all(any(has(x[2], v) for x in r) for v in ("alpha", "beta"))),
    ([Named("asset", ("deal",), any=("alpha",), exact=True)], lambda r: any(x[1] is not None and x[1].lower() == "alpha" for x in r)),
    ([Named("asset", exclude=("beta",))], lambda r: not any(has(x[1], "beta") or has(x[2], "beta") for x in r)),
    ([Named("asset", ("deal",), any=("alpha",), refinement=Scalar(include=("x",), exact=True))], lambda r: any(has(x[1], "alpha") and x[3] == "x" for x in r)),
    ([Named("asset", ("deal",), any=("gamma",), ids=("beta",))], lambda r: any(has(x[1], "gamma") or x[1] == "beta" for x in r)),
    ([Named("asset", (), any=("alpha",))], lambda r: False),
    ([Named("asset", (), exclude=("alpha",))], lambda r: True),
    ([Named("nothing", exclude=("alpha",))], lambda r: True),
    ([Named("asset")], lambda r: True),
    ([Between("paid", gte=2.0, lte=2.5)], lambda r: any(x[3] == "x" and x[4] == 2.0 for x in r)),
    ([Between("paid", gte=3.0, unknown=True)], lambda r: any(x[3] == "x" and x[4] == 3.0 for x in r) or not any(x[3] == "x" for x in r)),
    ([During("event", days=Dates(dt.date(2020, 1, 5), dt.date(2020, 1, 9)))], lambda r: any(x[5] is not None and dt.datetime(2020, 1, 5) <= x[5] < dt.datetime(2020, 1, 10) for x in r)),
    ([Companies("asset", ("deal",), several=((None, "alpha", ("x", "y")), ("GAMMA", None, ())))], lambda r: any(has(x[1], "alpha") and x[3] is not None for x in r) and any(x[1] == "GAMMA" for x in r)),
    ([Between("paid", gte=2.0, unknown=True), Named("asset", exclude=("beta",)), Named("asset", ("deal",), any=("alpha",))],
     lambda r: (any(x[3] == "x" and (x[4] or 0) >= 2 for x in r) or not any(x[3] == "x" for x in r)) and not any(has(x[1], "beta") or has(x[2], "beta") for x in r) and any(has(x[1], "alpha") for x in r)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_criteria_equal_a_reading_of_each_row(made, case):
    rows, facts, children = made
    criteria, test = CASES[case]
    want = [i for i in range(70) if test([x for x in rows if x[0] == i])]
    got = satisfying(facts, "deal_id", children, criteria)
    assert got.columns == ["deal_id", "at"]
    assert sorted(r.deal_id for r in got.collect()) == want


def test_who_told(made):
    rows, _, children = made
    got = {r.deal_id: r.told for r in told_by("deal_id", children, {"own": Named("asset", ("deal",), any=("gamma",)), "else": Named("asset", ("public",), any=("gamma",))}).collect()}
    want = {}
    for x in rows:
        if x[0] is not None:
            want.setdefault(x[0], set()).update(([] if not has(x[1], "gamma") else ["own"]) + ([] if not has(x[2], "gamma") else ["else"]))
    assert got == {k: sorted(v) for k, v in want.items() if v}


def test_no_children_and_repeated_facts(spark, made):
    _, facts, children = made
    none = [Child(children[0].rows.limit(0), children[0].evidence)]
    assert satisfying(facts, "deal_id", none, [Named("asset", any=("a",))]).count() == 0
    assert satisfying(facts, "deal_id", none, [Named("asset", exclude=("a",))]).count() == 70
    once = satisfying(facts, "deal_id", children, [Named("asset", any=("alpha",))]).count()
    assert satisfying(facts.unionByName(facts), "deal_id", children, [Named("asset", any=("alpha",))]).count() == 2 * once


def test_requests_are_checked():
    with pytest.raises(ValueError):
        Companies("company", several=(("C1", "name", ()),))
    with pytest.raises(ValueError):
        Between("paid", gte=2.0, lte=1.0)


def test_one_aggregation_for_all_criteria(spark):
    """Five criteria over lines cost one aggregation (partial and final) and one read of lineitem; unused children aren't read."""
    few = [Named("asset", any=("widget",)), Named("asset", exclude=("red",)), Named("modality", any=("o",)), Between("milestone", gte=1.0, unknown=True), During("event", days=Dates(gte=dt.date(1996, 1, 1)))]
    text = search(Domain(spark, DATA), few)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bAggregate\b", text)) == 1 and text.count("l_orderkey#") > 0
    assert len(re.findall(r"Relation \[.*l_orderkey", text)) == 1 and "s_suppkey" not in text and "c_custkey" not in text
