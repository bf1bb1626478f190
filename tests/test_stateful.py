"""Stateful streams: several batches out of order, restarts, deadlines and expiry against the same rules over all rows."""

from __future__ import annotations

import datetime as dt

import pytest

from dealmill.streaming import runner, stateful

START = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def hours(h: float) -> dt.datetime:
    return START + dt.timedelta(hours=h)


class Feed:
    """A folder that batches are written to, and a query over it that is stopped and started again for each."""

    def __init__(self, spark, tmp_path, schema, query):
        self.spark, self.path, self.schema, self.query, self.n = spark, str(tmp_path), schema, query, 0

    def send(self, rows) -> list:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = self.query(self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in"))
        before = self.told()
        with runner.keyed_state(self.spark):
            writer = stream.writeStream.option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True)
            writer.format("parquet").option("path", f"{self.path}/out").start().awaitTermination()
        self.schema_out = stream.schema
        return sorted(set(self.told()) - set(before))

    def told(self) -> list:
        try:
            return [tuple(r) for r in self.spark.read.schema(self.schema_out).parquet(f"{self.path}/out").collect()]
        except AttributeError:
            return []


def changes(rows, idle=240):
    out, last = [], {}
    for event_id, ts, user, status in sorted(rows, key=lambda r: (r[1], r[0])):
        was = last.get(user)
        if was and ts - was[0] <= dt.timedelta(hours=idle) and was[1] != status:
            out.append((user, event_id, was[1], status))
        last[user] = (ts, status)
    return sorted(out)


def test_transitions_of_batches_out_of_order_equal_those_of_all_rows(spark, tmp_path):
    kinds = ["a", "b", "a", "c", "c", "b"]
    rows = [(i, hours(i * 1.3), i % 3, kinds[(i * 7) % 6]) for i in range(90)]
    end = [(1000, hours(1000), 9, "z")]  # moves the watermark past everything
    order = sorted(rows, key=lambda r: r[0] + (r[0] * 37) % 12)  # up to 12 places late: less than the watermark
    feed = Feed(spark, tmp_path, EVENTS, lambda s: stateful.ordered_transitions(s, "24 hours"))
    for batch in (order[:30], order[30:55], order[55:], end):
        feed.send(batch)
    assert sorted(feed.told()) == changes(rows)
    assert len(feed.told()) == len(set(feed.told()))


def test_status_after_long_silence_is_a_baseline_and_state_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS, lambda s: stateful.ordered_transitions(s, "1 hours", idle_hours=10))
    feed.send([(1, hours(0), 1, "a"), (2, hours(5), 1, "b"), (3, hours(16), 1, "c")])
    feed.send([(4, hours(60), 2, "x")])
    feed.send([(5, hours(100), 2, "y"), (6, hours(101), 1, "a")])
    assert sorted(feed.told()) == [(1, 2, "a", "b")]
    state = spark.read.format("state-metadata").load(f"{tmp_path}/state").collect()
    assert state
    feed.send([(7, hours(300), 3, "z")])
    kept = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/state")
    assert {r["key"]["user_id"] for r in kept.collect()} <= {3}


def test_alert_and_recovery_once_each_and_silence_is_told_at_its_time(spark, tmp_path):
    runs = "source long, at timestamp_ntz, id long, status string"
    feed = Feed(spark, tmp_path, runs, lambda s: stateful.health_alerts(s, "1 hours"))
    feed.send([(1, hours(0), 1, "completed"), (1, hours(6), 3, "failed"), (2, hours(0), 9, "failed")])
    feed.send([(1, hours(5.5), 2, "failed"), (1, hours(7), 4, "failed"), (1, hours(8), 5, "completed"), (3, hours(8), 7, "completed")])
    feed.send([(4, hours(40), 6, "completed")])
    feed.send([(4, hours(42), 8, "completed")])
    at = lambda h: hours(h)
    told = sorted((s, t.replace(tzinfo=None), e, v) for s, t, e, v in feed.told())
    assert told == sorted([
        (1, at(4), "alert", "warning"), (1, at(5.5), "alert", "critical"), (1, at(8), "recovery", "ok"), (1, at(12), "alert", "warning"), (1, at(20), "alert", "critical"),
        (2, at(0), "alert", "critical"), (3, at(12), "alert", "warning"), (3, at(20), "alert", "critical"),
    ])


@pytest.mark.parametrize("with_known", [False, True])
def test_first_scan_is_silent_and_known_items_stay_silent(spark, tmp_path, with_known):
    found = "watcher long, scan string, id long, item string"
    known = spark.createDataFrame([(1, "p"), (1, "p"), (None, "q"), (3, "r")], "watcher long, item string") if with_known else None
    feed = Feed(spark, tmp_path, found, lambda s: stateful.first_seen(s, known))
    first = feed.send([(1, "01", 1, "p"), (1, "01", 2, "q"), (2, "01", 3, "p")])
    assert first == ([(1, "q", 2, "01")] if with_known else [])
    assert feed.send([(1, "02", 4, "q"), (2, "01", 5, "s"), (2, "02", 6, "s"), (2, "02", 7, "t"), (4, "02", 8, "t")]) == [(2, "t", 7, "02")]
    assert feed.send([(2, "03", 9, "t"), (4, "03", 10, "u"), (1, "03", 11, "w")]) == [(1, "w", 11, "03"), (4, "u", 10, "03")]
