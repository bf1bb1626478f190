"""The archive of raw responses."""

from __future__ import annotations

import datetime as dt

import pytest

from dealmill.sources.archive import Archive

SCHEMA = "source string, id string, body string, fetched_at timestamp_ntz, extra int"


def at(day: int) -> dt.datetime:
    return dt.datetime(2024, 1, day)


def test_contents_bumped_returning_and_repeated(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"))
    assert archive.contents().count() == archive.current().count() == 0
    first = [("s", "1", "one", at(1), 0), ("s", "1", "one", at(1), 1), ("s", "2", None, at(1), 0), ("t", "1", "one", at(1), 0)]
    add = lambda rows: archive.add(spark.createDataFrame(rows, SCHEMA))
    add(first)
    add([("s", "1", "two", at(2), 0), ("s", "2", None, at(2), 0)])
    add([("s", "1", "one", at(3), 0)])  # an old content comes back
    add(first)  # a run is repeated
    add([])
    got = {(r.source, r.id, r.body): (r.first_fetched, r.last_fetched, r.fetches) for r in archive.bodies(archive.contents()).collect()}
    assert got == {("s", "1", "one"): (at(1), at(3), 2), ("s", "1", "two"): (at(2), at(2), 1), ("s", "2", None): (at(1), at(2), 2), ("t", "1", "one"): (at(1), at(1), 1)}
    now = lambda asof=None: {(r.source, r.id): r.body for r in archive.bodies(archive.current(asof)).collect()}
    assert now() == {("s", "1"): "one", ("s", "2"): None, ("t", "1"): "one"}
    assert now("2024-01-02 12:00:00")["s", "1"] == "two"
    assert spark.read.parquet(str(tmp_path / "a" / "bodies")).count() == 4


def test_a_stop_before_the_ledger_is_mended_by_the_next_run(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"))
    rows = spark.createDataFrame([("s", "1", "one", at(1), 0)], SCHEMA)
    archive.add(rows)
    (tmp_path / "a" / "fetches").rename(tmp_path / "lost")
    assert archive.contents().count() == 0
    archive.add(rows)
    assert archive.contents().first().fetches == 1 and spark.read.parquet(str(tmp_path / "a" / "bodies")).count() == 1


def test_rows_that_cannot_be_found_again_raise(spark, tmp_path):
    for row in ((None, "1", "x", at(1), 0), ("s", None, "x", at(1), 0), ("s", "1", "x", None, 0)):
        with pytest.raises(Exception, match="a response has no"):
            Archive(spark, str(tmp_path / "b")).add(spark.createDataFrame([row], SCHEMA))
