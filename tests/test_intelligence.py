"""Scopes, dossiers, chained merges and replaced children against plain loops, and what a stopped change leaves."""

from __future__ import annotations

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from dealmill.operators import merges, scopes
from dealmill.plans import QUERIES
from dealmill.sources.children import Children


def test_scopes_by_the_nearest_place_exclusion_first(spark):
    tree = spark.createDataFrame([("us", "america"), ("ca", "america"), ("fr", "europe"), ("america", "world"), ("europe", "world"), ("paris", "fr")], "place string, within string")
    above = scopes.ancestry(tree)
    assert {(r.above, r.steps) for r in above.where("place = 'paris'").collect()} == {("paris", 0), ("fr", 1), ("europe", 2), ("world", 3)}
    said = [(1, "world", False, 10), (1, "us", True, 11), (1, "us", False, 12), (2, "europe", True, 20), (2, "world", False, 21), (2, "world", False, 22), (2, "world", False, 21), (3, None, False, 1), (None, "us", False, 1), (3, "fr", False, None)]
    claims = spark.createDataFrame(said, "claim long, place string, excluded boolean, evidence long")
    places = spark.createDataFrame([("us",), ("ca",), ("paris",), ("mars",)], "place string")
    got = {(r.claim, r.place): (r.scope, r.conflict, r.n_evidence, r.evidence) for r in scopes.scopes(claims, places, above).collect()}
    assert got == {
        (1, "us"): ("explicitly_excluded", True, 1, [11]), (1, "ca"): ("included_via_world", False, 1, [10]), (1, "paris"): ("included_via_world", False, 1, [10]),
        (2, "us"): ("included_via_world", False, 2, [21, 22]), (2, "ca"): ("included_via_world", False, 2, [21, 22]), (2, "paris"): ("excluded_via_europe", True, 1, [20]),
        (3, "paris"): ("included_via_fr", False, 0, None),
    }


def test_dossiers_take_few_shuffles(spark):
    text = QUERIES["company_dossiers"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text
    assert text.split("== Initial Plan ==")[-1].count("FileScan parquet") <= 4  # lines and deals once for the entries, once for the counts


def test_chains_end_where_no_redirect_goes_on(spark):
    redirects = [(i, i - 1) for i in range(1, 70)] + [(100, 101), (102, 101), (7, 6), (5, None), (9000, 9000)]
    got = {r.id: (r.root, r.depth) for r in merges.resolved(spark.createDataFrame(redirects, "id long, into long")).collect()}
    assert got == {**{i: (0, i) for i in range(1, 70)}, 100: (101, 1), 102: (101, 1)}
    for bad in ([(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 1), (8, 9)], [(1, 2), (1, 3)]):
        with pytest.raises(ValueError):
            merges.resolved(spark.createDataFrame(bad, "id long, into long"))
    assert merges.resolved(spark.createDataFrame([], "id long, into long")).count() == 0


def test_fields_are_filled_from_the_nearest_and_links_carried(spark):
    rows = [(1, None, "x", None), (2, "b", None, None), (3, "c", "y", 3), (4, "d", None, 4), (9, "e", None, None)]
    entities, redirects = spark.createDataFrame(rows, "id long, a string, b string, c int"), spark.createDataFrame([(2, 1), (3, 2), (4, 1)], "id long, into long")
    assert {tuple(r) for r in merges.merged(entities, redirects, "id", ["a", "b", "c"]).collect()} == {(1, "b", "x", 4), (9, "e", None, None)}
    links = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 4), (8, 9), (8, None)], "deal long, id long")
    assert sorted(((r.deal, r.id) for r in merges.carried(links, redirects, "id").collect()), key=str) == [(7, 1), (8, 1), (8, 9), (8, None)]


SCHEMA = "parent long, name string, version int, at int"


def children(spark, tmp_path, buckets=4):
    return Children(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, "parent", buckets)


def rows_of(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_children_are_replaced_promoted_and_purged(spark, tmp_path):
    r, store, held = random.Random(2), children(spark, tmp_path), {}
    assert rows_of(store) == []
    for step in range(4):
        parents = r.sample(range(12), 5)
        batch = [(p, f"n{k}", r.choice([step, 1]), r.randint(0, 9)) for p in parents for k in range(r.randint(1, 3))]
        store.replace(spark.createDataFrame(batch, SCHEMA), "version")
        for p in parents:
            new, old = [b for b in batch if b[0] == p], held.get(p)
            if old is None or max(b[2] for b in new) > max(b[2] for b in old):
                held[p] = new
        assert rows_of(store) == sorted(b for rows in held.values() for b in rows)
    store.purge(F.col("at") < 4)
    assert rows_of(store) == sorted(b for rows in held.values() for b in rows if b[3] >= 4)
    with pytest.raises(ValueError):
        store.replace(spark.createDataFrame([(None, "x", 1, 1)], SCHEMA))


def test_a_change_that_stops_before_its_manifest_never_was(spark, tmp_path, monkeypatch):
    store = children(spark, tmp_path)
    store.replace(spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], SCHEMA))
    before = rows_of(store)
    with monkeypatch.context() as m:
        m.setattr(Children, "_swap", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            store.replace(spark.createDataFrame([(1, "z", 2, 2)], SCHEMA))
    assert rows_of(children(spark, tmp_path)) == before
    # of two writers that began with the same rows one is refused
    number, old = store._now()
    store.replace(spark.createDataFrame([(1, "c", 2, 2)], SCHEMA))
    with pytest.raises(RuntimeError):
        store._write(spark.createDataFrame([(1, "lost", 2, 2)], SCHEMA), [0, 1, 2, 3], old, number + 1)
    assert (1, "c", 2, 2) in rows_of(store)
    store.drop_older()
    kept = [s for s in (tmp_path / "rows").iterdir() if not s.name.startswith(".")]
    assert rows_of(store) == [(1, "c", 2, 2), (2, "b", 1, 1)] and len(kept) == 2 and len(list((tmp_path / "manifests").glob("*.json"))) == 1


def test_bad_children_are_kept_aside(spark, tmp_path):
    store = children(spark, tmp_path)
    store.replace(spark.createDataFrame([(1, "old", 1, 1), (2, "old", 1, 1)], SCHEMA))
    batch = spark.createDataFrame([(1, "new", 1, 1), (1, None, 1, -1), (2, "bad", 1, -5)], SCHEMA)
    store.store(batch, {"named": F.col("name").isNotNull(), "dated": F.col("at") > 0})
    assert rows_of(store) == [(1, "new", 1, 1), (2, "old", 1, 1)]
    assert {(r.parent, r.error) for r in spark.read.parquet(f"{tmp_path}/errors").collect()} == {(1, "named, dated"), (2, "dated")}


def test_dossiers_are_dealt_out_once_and_busy_subjects_are_not_held_by_one_task(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 2, 2, 3]), r.randint(1, 30), r.choice([None, *range(9)]), r.random() < 0.7) for _ in range(400)]
    links = spark.createDataFrame(rows, "s long, a long, at int, keep boolean")
    sections = {"a": (F.col("a"), F.col("at"), F.col("keep")), "pair": (F.concat_ws("-", "a", "at"), F.col("at"), F.lit(True))}
    told = lambda hot: scopes.dossiers(links, "s", sections, 5, hot)
    got = sorted(map(tuple, told(10**6).select("subject", "section", "place", "id", "links", "last", "of").collect()), key=str)
    assert got == sorted(map(tuple, told(100).select("subject", "section", "place", "id", "links", "last", "of").collect()), key=str)
    held = {}
    for s, a, at, keep in rows:
        for section, i in (("a", str(a) if keep else None), ("pair", f"{a}-{at}" if at is not None else str(a))):
            if s is not None and i is not None:
                held.setdefault((s, section), {}).setdefault(i, []).append(at)
    want = []
    for (s, section), ids in held.items():
        last = {i: max((x for x in ats if x is not None), default=None) for i, ats in ids.items()}
        first = sorted(ids, key=lambda i: (last[i] is None, -(last[i] or 0), i))[:5]
        want += [(s, section, n + 1, i, len(ids[i]), last[i], len(ids)) for n, i in enumerate(first)]
    assert got == sorted(want, key=str)
    plan = QUERIES["asset_dossiers"](spark, DATA)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(") <= 3 and plan.count("REPARTITION_BY_COL") == 1  # the join's two sides, if it has any, and one by subject
