"""Operators that keep state for each key and wait for the watermark, so that results do not depend on batches.

Rows may come out of order within the watermark. A key's rows wait in its state until the watermark has passed them,
then they are taken in the order of (time, id). A timer at the earliest waiting row wakes the key; timers at deadlines
of its own tell what happens when nothing comes. Rows behind the watermark are late and left out by Spark.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
CHANGE = Row("user_id", "event_id", "was", "event_type")
TOLD = Row("source", "at_us", "event", "severity")
ALERT = Row("watcher", "item", "id", "scan")


def _timer(us: int) -> int:
    """The first millisecond that is not before a time in microseconds."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Keeps rows (at, id, status) of a key until the watermark has passed them and hands them on in order."""

    #: Schema of the key's own state, next to the rows that wait.
    kept = "status string, at long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, status string")
        self.state = handle.getValueState("state", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["_at"], r["_id"], r["_status"]) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(_timer(min(r[0] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= until], [r for r in rows if r[0] > until]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(_timer(later[0][0]))
        elif rows:
            self.waiting.clear()
        yield from self.advance(key, due, until)

    @abstractmethod
    def advance(self, key, due: list[tuple[int, int, str]], until: int) -> Iterator[Row]:
        """Takes the next rows in order; time has come to ``until`` (microseconds)."""

    def close(self) -> None:
        pass


@dataclass
class Transitions(InOrder):
    """Changes of a key's status. Its first status, and one after ``idle`` microseconds of silence, is silent."""

    idle: int

    def advance(self, key, due, until):
        last = self.state.get() if self.state.exists() else None
        for at, row_id, status in due:
            if last and at - last[1] <= self.idle and last[0] != status:
                yield CHANGE(*key, row_id, last[0], status)
            last = (status, at)
        if last and last[1] + self.idle < until and not self.waiting.exists():
            self.state.clear()  # nothing that still may come can be compared with it
        elif due:
            self.state.update(last)
            self.handle.registerTimer(_timer(last[1] + self.idle) + 1)


@dataclass
class Health(InOrder):
    """Alerts and recoveries of a source: a failed run is critical at once, a source without success turns to
    warning, then to critical. Each change of severity is told once; back to health is told as recovery.
    """

    warn: int
    critical: int

    kept = "severity string, success long, failed boolean, since long"

    def _severity(self, success: int | None, failed: bool, now: int) -> str:
        if failed or success is None or now >= success + self.critical:
            return "critical"
        return "warning" if now >= success + self.warn else "ok"

    def advance(self, key, due, until):
        told, success, failed, since = self.state.get() if self.state.exists() else ("ok", None, False, 0)
        if told == "ok" and success is None and not due:
            return

        def tell(at: int) -> Iterator[Row]:
            nonlocal told
            now = self._severity(success, failed, at)
            if now != told:
                yield TOLD(*key, at, "recovery" if now == "ok" else "alert", now)
                told = now

        def pass_deadlines(before: int) -> Iterator[Row]:
            if success is not None and not failed:
                for at in (success + self.warn, success + self.critical):
                    if since < at < before:
                        yield from tell(at)

        for at, _, status in due:
            yield from pass_deadlines(at)
            failed = status == "failed"
            success = success if failed else at
            yield from tell(at)
        yield from pass_deadlines(until + 1)
        self.state.update((told, success, failed, until))
        for deadline in (success + self.warn, success + self.critical) if success is not None and not failed else ():
            if deadline > until:
                self.handle.registerTimer(_timer(deadline))


class FirstSeen(StatefulProcessor):
    """Alerts on what a watcher has not seen. What the initial state holds is known; without one, the watcher's
    first scan is silent and only remembered.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "item string", "known boolean")
        self.base = handle.getValueState("base", "scan string")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.updateValue((initialState["item"],), (True,))
        self.base.update(("",))  # before every scan

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted((r["scan"], r["id"], r["item"]) for r in rows)
        if not self.base.exists():
            self.base.update((rows[0][0],))
        (base,) = self.base.get()
        for scan, row_id, item in rows:
            if not self.seen.containsKey((item,)):
                self.seen.updateValue((item,), (True,))
                if scan != base:
                    yield ALERT(*key, item, row_id, scan)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, key: str, at: Column, row_id: Column, status: Column, watermark: str) -> DataFrame:
    at = at.cast("timestamp")
    return rows.select(key, at.alias("_time"), F.unix_micros(at).alias("_at"), row_id.cast("long").alias("_id"), status.alias("_status")).withWatermark("_time", watermark)


def ordered_transitions(events: DataFrame, watermark: str = "2 days", idle_hours: int = 240) -> DataFrame:
    """user_id, event_id, was, event_type: changes of a user's status in the order of (ts, event_id), whatever the
    order and batches that rows come in. A status after ``idle_hours`` of silence is a new baseline; state that old
    goes. Rows without user, time or status are left out.
    """
    rows = _timed(events.where("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL"), "user_id", F.col("ts"), F.col("event_id"), F.col("event_type"), watermark)
    return rows.groupBy("user_id").transformWithState(Transitions(idle_hours * HOUR), "user_id long, event_id long, was string, event_type string", "append", "eventTime")


def health_alerts(runs: DataFrame, watermark: str = "2 days", warn_hours: int = 4, critical_hours: int = 12) -> DataFrame:
    """source, at, event, severity: alerts and recoveries of sources from runs (source, at, id, status).

    Status "failed" is critical, any other a success. Severity also changes when no run comes in time, at the very
    time it does, not at that of the next row.
    """
    rows = _timed(runs.where("source IS NOT NULL AND at IS NOT NULL"), "source", F.col("at"), F.col("id"), F.coalesce("status", F.lit("")), watermark)
    out = rows.groupBy("source").transformWithState(Health(warn_hours * HOUR, critical_hours * HOUR), "source long, at_us long, event string, severity string", "append", "eventTime")
    return out.select("source", F.timestamp_micros("at_us").alias("at"), "event", "severity")


def first_seen(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """watcher, item, id, scan: one alert for each watcher and item, from found (watcher, scan, id, item).

    ``known`` (watcher, item) is what watchers knew before the stream began. A watcher that is not in it stays silent
    in its first scan; all rows of a scan share its name, and names order scans. Rows come scan by scan.
    """
    rows = found.where("watcher IS NOT NULL AND scan IS NOT NULL AND item IS NOT NULL")
    initial = None if known is None else known.where("watcher IS NOT NULL AND item IS NOT NULL").select("watcher", "item").distinct().groupBy("watcher")
    return rows.groupBy("watcher").transformWithState(FirstSeen(), "watcher long, item string, id long, scan string", "append", "none", initial)
