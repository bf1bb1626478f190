"""Two-lane sync with a stop in the middle, and saved searches over several batches, against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from dealmill.operators import saved_searches
from dealmill.streaming import lanes

DAY0 = dt.date(2024, 1, 1)
SCHEMA = "id long, dated timestamp_ntz, version int, name string"


def day(n: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, registry, lane, archive, today, stored=lambda n: None):
    q = lanes.start_lane(spark, registry, "dated", lane, archive, DAY0, today, days=7, overlap=3, stored=stored)
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_lanes_move_apart_and_a_stopped_lane_loses_and_doubles_nothing(spark, tmp_path):
    archive, rows = str(tmp_path), [(i, day(i % 40 + 0.5), 1, f"n{i}") for i in range(200)] + [(999, None, 1, "no date")]
    registry = spark.createDataFrame(rows, SCHEMA)
    today, batches = DAY0 + dt.timedelta(days=39), []

    def stop_at_third(n):
        batches.append(n)
        if n == 2:
            raise RuntimeError("stopped between storing a window and committing it")

    run(spark, registry, "recent", archive, today)
    with pytest.raises(Exception, match="stopped"):
        run(spark, registry, "backfill", archive, today, stop_at_third)
    seen = lanes.synced(spark, archive, registry.schema, "id", "version")
    assert {r.id for r in seen.collect()} == {i for i in range(200) if i % 40 < 21 or i % 40 >= 36}
    run(spark, registry, "backfill", archive, today, batches.append)
    assert batches == [0, 1, 2, 2, 3, 4, 5]  # the window that was stored but not committed came again
    got = lanes.synced(spark, archive, registry.schema, "id", "version").collect()
    assert sorted((r.id, r.name) for r in got) == [(i, f"n{i}") for i in range(200)]
    assert {r.lanes for r in got if r.id % 40 >= 36} == {"backfill,recent"} and {r.lanes for r in got if r.id % 40 < 36} == {"backfill"}
    # a later day: both lanes go on from where they were, and a changed row's newest version counts
    later = spark.createDataFrame(rows + [(7, day(41), 2, "newer"), (500, day(42), 1, "new")], SCHEMA)
    batches.clear()
    for lane in ("recent", "backfill"):
        run(spark, later, lane, archive, DAY0 + dt.timedelta(days=43), batches.append)
    assert batches == [1, 6]
    got = {r.id: r for r in lanes.synced(spark, archive, registry.schema, "id", "version").collect()}
    assert len(got) == 201 and got[7].name == "newer" and got[500].lanes == "backfill,recent"


def test_windows_of_an_interrupted_batch_are_the_same():
    options = {"lane": "backfill", "begins": "2024-01-01", "today": "2024-01-10", "days": "7", "overlap": "2"}
    w = lanes.Windows(options)
    rows, end = w.read(w.initialOffset())
    assert list(rows) == list(w.readBetweenOffsets(w.initialOffset(), end)) == [("backfill", DAY0, DAY0 + dt.timedelta(days=6))]
    assert list(w.read({"covered": "2024-01-10"})[0]) == []
    with pytest.raises(ValueError):
        lanes.Windows(options | {"lane": "other"})


FIELDS = {"company": "companies", "area": "areas"}
ROWS = "id long, value double, created_at timestamp_ntz, companies array<string>, areas array<string>"


def test_a_thousand_searches_each_match_told_once(spark, tmp_path):
    r = random.Random(5)
    names = ["Alpha", "alphabet", "Beta Bio", "Ωmega", "x", "AB", "Gamma-Bio", ""]
    words = ["alpha", "BIO", "ω", "x", "ab", "nowhere", "", None, None]
    rows = [(i, r.choice([None, 0.0, -5.0, 10.0 ** r.randint(0, 9), float(r.randint(0, 500))]), day(r.randint(0, 9)), r.choice([None, [], r.sample(names, 2), [r.choice(names), None]]), [r.choice(names)]) for i in range(60)]
    searches = [(k, r.choice(words), r.choice(words), r.choice([None, None, 10.0, 1e5]), r.choice([None, None, 100.0, 1e6]), r.choice([None, day(4)])) for k in range(1000)]

    def answers(row, s):
        _, value, created, companies, areas = row
        _, company, area, least, most, since = s
        has = lambda word, held: not word or any(v is not None and word.lower() in v.lower() for v in held or [])
        inside = (least is None or (value is not None and value >= least)) and (most is None or (value is not None and value <= most))
        return has(company, companies) and has(area, areas) and inside and (since is None or created > since)

    want = {(s[0], row[0]) for s in searches for row in rows if answers(row, s)}
    values = spark.createDataFrame([(f, n) for f in FIELDS for n in names], "field string, value string")
    index = saved_searches.search_index(spark.createDataFrame(searches, "search_id long, company string, area string, least double, most double, since timestamp_ntz"), values, FIELDS)
    put, told = saved_searches.tell_once(index, FIELDS, f"{tmp_path}/told"), f"{tmp_path}/told"
    frame = lambda part: spark.createDataFrame(part, ROWS)
    put(frame(rows[:40]), 0)
    put(frame(rows[20:]), 1)  # rows come again
    put(frame(rows[20:]), 1)  # a batch that is run again
    put(frame([]), 2)
    got = [(x.search_id, x.id) for x in spark.read.parquet(told).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_blocks_of_a_range_cover_it_and_are_few(spark):
    r = random.Random(1)
    ranges = [(a, a * 10.0 ** r.randint(0, 5)) for a in (10.0 ** r.uniform(0, 9) for _ in range(50))] + [(None, 5.0), (3.0, None), (7.0, 7.0)]
    df = spark.createDataFrame(ranges, "least double, most double")
    from pyspark.sql import functions as F

    for row in df.select("least", "most", saved_searches._blocks_of_range(F.col("least"), F.col("most")).alias("b"), saved_searches._step(F.col("least")).alias("a"), saved_searches._step(F.col("most")).alias("z")).collect():
        a, z = row.a if row.least is not None else 0, row.z if row.most is not None else 2**12 - 1
        steps = sorted(s for k, n in (map(int, b.split(":")) for b in row.b) for s in range(n * 2**k, (n + 1) * 2**k))
        assert steps == list(range(a, z + 1)) and len(row.b) <= 24


def test_matches_are_not_dealt_out_again_unless_ids_are_repeated(spark):
    day = dt.datetime(2020, 1, 1)
    frame = lambda ids: spark.createDataFrame([(i, 5.0, day, ["Alpha One", "alpha two", "ALPHA ONE", None], ["x"]) for i in ids], ROWS)
    asked = lambda ids: spark.createDataFrame([(i, "alpha", None, None, None, None) for i in ids] + [(9, None, None, 1.0, 7.0, None)], "search_id long, company string, area string, least double, most double, since timestamp_ntz")
    values = spark.createDataFrame([("company", "Alpha One"), ("company", "Alpha Two"), ("company", "alpha three"), ("area", "x")], "field string, value string")
    index = saved_searches.search_index(asked([1, 2]), values, FIELDS)
    assert saved_searches.told_apart(index) and not saved_searches.told_apart(saved_searches.search_index(asked([1, 9]), values, FIELDS))
    found = saved_searches.matches(frame([10, 11]), index, FIELDS, True)
    assert sorted(map(tuple, found.collect())) == [(s, i) for s in (1, 2, 9) for i in (10, 11)]
    assert "keys=[search_id" not in found._jdf.queryExecution().executedPlan().toString()
    again = saved_searches.matches(frame([10, 10]), index, FIELDS)
    assert sorted(map(tuple, again.collect())) == [(1, 10), (2, 10), (9, 10)]
