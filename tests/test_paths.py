"""Chains over groups against a listing of all of them."""

from __future__ import annotations

import random

import pytest

from dealmill.operators.paths import distances, shortest_chains, shortest_paths
from dealmill.operators.topk import interleave


def all_shortest(groups: list[set[str]], a: str, b: str, most: int) -> list[str]:
    level = {(a,)}
    for _ in range(most + 1):
        if done := sorted(">".join(p) for p in level if p[-1] == b):
            return done
        level = {(*p, v) for p in level for g in groups if p[-1] in g for v in g if v not in p}
    return []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_chains_equal_a_full_listing(spark, seed):
    rng = random.Random(seed)
    groups = [set(rng.sample("abcdefghijklm", rng.choice([1, 2, 2, 3]))) for _ in range(14)]
    members = [(i, v) for i, g in enumerate(groups) for v in g] + [(None, "a"), (3, None)]
    df = spark.createDataFrame(members + members[:5], "group int, id string")  # repeated members change nothing
    for a, b, most, limit in (("a", "m", 5, 3), ("c", "k", 2, 2), ("b", "b", 3, 5), ("a", "zz", 3, 5)):
        got = [">".join(r.path) for r in shortest_chains(df, a, b, most, limit).collect()]
        assert sorted(got) == all_shortest(groups, a, b, most)[:limit]


def test_a_hub_keeps_a_few_rows(spark):
    """a and b both know 3,000 others: of the 3,000 chains the first five by name."""
    edges = spark.createDataFrame([(s, f"v{i:04}") for s in "ab" for i in range(3000)], "src string, dst string")
    assert [r.path for r in shortest_paths(edges, "a", "b", 4).collect()] == [["a", f"v{i:04}", "b"] for i in range(5)]


def test_distances_end_early_and_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.id: r.hops for r in distances(edges, ["a", "a"], 50).collect()} == {"a": 0, "b": 1, "c": 1}


def test_interleave_cuts_before_it_numbers(spark):
    rows = spark.range(1000).selectExpr("id", "id % 10 AS score")
    out = interleave([rows, rows.where("id < 2")], 5)
    assert [(r.source, r.id) for r in out.collect()] == [(0, 9), (1, 1), (0, 19), (1, 0), (0, 29)]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
