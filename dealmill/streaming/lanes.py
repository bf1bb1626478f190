"""Two-lane synchronisation: a recent lane that reads the last days again, and a backfill lane that walks history.

A Python streaming source gives each lane its own cursor: its offsets are days, its rows are windows to fetch. Spark
logs an offset before a window is fetched and commits it when the window is stored, so a lane that was stopped goes
on with the very window it was at. Rows are fetched by Spark's own reader, with the window as a pushed filter, and
stored under the window's name: fetching it again replaces it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

DAY = dt.timedelta(days=1)


class Windows(SimpleDataSourceStreamReader):
    """Offsets: the last day that a lane has covered. A batch is one window; without one left there is no batch."""

    def __init__(self, options: dict):
        day = lambda name: dt.date.fromisoformat(options[name])
        self.lane, self.begins, self.today = options["lane"], day("begins"), day("today")
        self.days, self.overlap = max(1, int(options["days"])), max(1, int(options["overlap"]))
        if self.lane not in ("recent", "backfill"):
            raise ValueError("a lane is recent or backfill")

    def initialOffset(self) -> dict:
        return {"covered": str(self.begins - DAY)}

    def _next(self, covered: dt.date) -> tuple[dt.date, dt.date]:
        if self.lane == "recent":
            return self.today - self.overlap * DAY, self.today
        return covered + DAY, min(self.today, covered + self.days * DAY)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        covered = dt.date.fromisoformat(start["covered"])
        if covered >= self.today:
            return iter(()), start
        first, last = self._next(covered)
        return iter([(self.lane, first, last)]), {"covered": str(last)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The windows of a batch that was begun before a stop."""
        covered, last = dt.date.fromisoformat(start["covered"]), dt.date.fromisoformat(end["covered"])
        if covered >= last:
            return iter(())
        if self.lane == "recent":
            return iter([(self.lane, last - self.overlap * DAY, last)])
        return iter([(self.lane, covered + DAY, last)])

    def commit(self, end: dict) -> None:
        pass


class SyncWindows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sync_windows"

    def schema(self) -> str:
        return "lane string, first date, last date"

    def simpleStreamReader(self, schema: StructType) -> Windows:
        return Windows(self.options)


def start_lane(
    spark: SparkSession, registry: DataFrame, at: str, lane: str, archive: str, begins: dt.date, today: dt.date, days: int = 31, overlap: int = 2, stored: Callable[[int], None] = lambda n: None
) -> StreamingQuery:
    """Runs a lane over ``registry`` (dated by ``at``) up to ``today``, into folders below ``archive``.

    The backfill lane begins at ``begins``. ``stored`` is told each batch number when its rows are stored. Rows
    without a date belong to no window.
    """
    spark.dataSource.register(SyncWindows)

    def put(batch: DataFrame, number: int) -> None:
        for w in batch.collect():  # one window, or the one that a stop interrupted
            day = F.col(at).cast("date")
            inside = registry.where((F.col(at) >= F.lit(w["first"]).cast(registry.schema[at].dataType)) & (day <= F.lit(w["last"])))
            inside.write.mode("overwrite").parquet(f"{archive}/rows/lane={lane}/first={w['first']}")
        stored(number)

    options = {"lane": lane, "begins": str(begins), "today": str(today), "days": str(days), "overlap": str(overlap)}
    windows = spark.readStream.format("sync_windows").options(**options).load()
    return windows.writeStream.option("checkpointLocation", f"{archive}/_lanes/{lane}").foreachBatch(put).start()


def synced(spark: SparkSession, archive: str, schema: StructType, key: str, version: str) -> DataFrame:
    """The newest version of each key over both lanes, with the lanes that brought it."""
    rows = spark.read.schema(StructType([*schema.fields]).add("lane", "string").add("first", "date")).parquet(f"{archive}/rows")
    others = [c for c in schema.names if c != key]
    newest = F.max_by(F.struct(*others), F.struct(version, "first")).alias("_row")
    return rows.groupBy(key).agg(newest, F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("lanes")).select(key, "_row.*", "lanes")
