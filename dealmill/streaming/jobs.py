"""Rules of scheduled ingestion: windows, safety gates, leases, retries, retention. Pure functions and Columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reread_from(last_completed: dt.date | None, overlap_days: int = 2) -> dt.date | None:
    """Where an overlapping re-read begins; the overlap is one day at least; None reads everything."""
    return None if last_completed is None else last_completed - dt.timedelta(days=max(1, overlap_days))


def backfill_window(cursor: dt.date, today: dt.date, batch_days: int, overlap_days: int = 2) -> tuple[dt.date, dt.date]:
    """The next bounded window behind the cursor; once caught up, the overlap is read again."""
    if cursor >= today:
        return today - dt.timedelta(days=max(1, overlap_days)), today
    return cursor + dt.timedelta(days=1), min(today, cursor + dt.timedelta(days=max(1, batch_days)))


def empty_is_safe(source_total: int, watermark: dt.datetime, now: dt.datetime) -> bool:
    """Whether a result without rows may be believed: the source has rows, the watermark is neither in the future nor stale."""
    return source_total > 0 and watermark <= now + dt.timedelta(minutes=5) and now - watermark <= dt.timedelta(days=7)


def retry_after_minutes(attempts: Column, first: int = 15, doublings: int = 5) -> Column:
    """15 minutes, doubled with each further attempt, five times at most."""
    return (F.lit(first) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(doublings)))).cast("long")


@dataclass(frozen=True)
class Lease:
    """Which items of a work queue are due."""

    version: int
    max_attempts: int = 3
    stuck_after: str = "INTERVAL 1 HOUR"

    def due(self, items: DataFrame, now: Column, limit: int) -> DataFrame:
        """items: id, status, version, attempts, next_retry_at, started_at. Never done, done by an older version, failed
        and due again, or stuck; oldest ids first."""
        failed = (F.col("status") == "failed") & (F.col("attempts") < self.max_attempts) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
        stuck = (F.col("status") == "in_progress") & (F.col("started_at") < now - F.expr(self.stuck_after))
        older = (F.col("status") == "done") & (F.col("version") < self.version)
        return items.where(F.col("status").isNull() | older | failed | stuck).orderBy("id").limit(limit)


def kept_since(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Retention: rows younger than so many days; rows without a time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= now - F.expr(f"INTERVAL {int(days)} DAY")))


def new_matches(rows: DataFrame, searches: DataFrame) -> DataFrame:
    """Saved-search alerts: rows (id, kind, value, created_at) that searches (search_id, kind, least, last_run_at) ask for
    and that came after their last run; a search that never ran takes all."""
    s = searches.select("search_id", F.col("kind").alias("_kind"), "least", "last_run_at")
    hit = (F.col("kind") == F.col("_kind")) & (F.col("value") >= F.col("least")) & (F.col("last_run_at").isNull() | (F.col("created_at") > F.col("last_run_at")))
    return rows.join(s, hit).select("search_id", "id")
