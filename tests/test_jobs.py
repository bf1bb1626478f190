from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dealmill.streaming import jobs

DAY, NOW = dt.date(2024, 1, 10), dt.datetime(2024, 1, 10, 12)


def test_windows():
    assert jobs.reread_from(None) is None and jobs.reread_from(DAY, 0) == dt.date(2024, 1, 9)
    assert jobs.backfill_window(dt.date(2024, 1, 1), DAY, 5) == (dt.date(2024, 1, 2), dt.date(2024, 1, 6))
    assert jobs.backfill_window(dt.date(2024, 1, 8), DAY, 5) == (dt.date(2024, 1, 9), DAY)
    assert jobs.backfill_window(DAY, DAY, 5) == (dt.date(2024, 1, 8), DAY)


def test_empty_results():
    hour = dt.timedelta(hours=1)
    assert jobs.empty_is_safe(5, NOW - hour, NOW)
    assert not jobs.empty_is_safe(0, NOW, NOW) and not jobs.empty_is_safe(5, NOW + hour, NOW) and not jobs.empty_is_safe(5, NOW - 200 * hour, NOW)


def test_leases_retries_and_retention(spark):
    rows = [(1, None, None, 0, None, None), (2, "done", 1, 1, None, None), (3, "done", 2, 1, None, None), (4, "failed", 2, 1, NOW - dt.timedelta(hours=1), None),
            (5, "failed", 2, 3, None, None), (6, "failed", 2, 1, NOW + dt.timedelta(hours=1), None), (7, "in_progress", 2, 1, None, NOW - dt.timedelta(hours=2)), (8, "in_progress", 2, 1, None, NOW)]
    df = spark.createDataFrame(rows, "id int, status string, version int, attempts int, next_retry_at timestamp_ntz, started_at timestamp_ntz")
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    assert [r.id for r in jobs.Lease(2).due(df, now, 10).collect()] == [1, 2, 4, 7]
    waits = df.select(jobs.retry_after_minutes(F.col("id")).alias("m")).collect()
    assert [r.m for r in waits] == [15, 30, 60, 120, 240, 480, 480, 480]
    assert jobs.kept_since(df, "next_retry_at", now, 0).count() == 7


def test_saved_searches(spark):
    rows = spark.createDataFrame([(1, "a", 5.0, NOW), (2, "a", 1.0, NOW), (3, "b", 9.0, NOW)], "id int, kind string, value double, created_at timestamp_ntz")
    searches = spark.createDataFrame([(10, "a", 2.0, None), (11, "b", 1.0, NOW), (12, "b", 1.0, dt.datetime(2024, 1, 1))], "search_id int, kind string, least double, last_run_at timestamp_ntz")
    assert {(r.search_id, r.id) for r in jobs.new_matches(rows, searches).collect()} == {(10, 1), (12, 3)}
