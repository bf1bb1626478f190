"""Lists read page by page: typed filters, a cursor of several columns, details for the page alone; grouped search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.operators.topk import after

MOST = 100


@dataclass(frozen=True)
class Listing:
    """Rows in the order of ``keys``, which together tell rows apart and hold no null; filters by name; details of a page."""

    rows: DataFrame
    keys: tuple[str, ...]
    filters: Mapping[str, Callable[[DataFrame, object], DataFrame]] = field(default_factory=dict)
    details: Callable[[DataFrame], DataFrame] | None = None

    def page(self, limit: int = 50, behind: Sequence | None = None, **asked) -> DataFrame:
        """The next ``limit`` rows behind a row's keys, with ``has_more``.

        Filters that are asked with None are left out; an unknown one raises. Rows are cut before details are joined,
        so those read no more than the page's keys; one row more than the page is read, none is counted.
        """
        if not 1 <= limit <= MOST:
            raise ValueError(f"limit must be 1 to {MOST}")
        if unknown := sorted(set(asked) - set(self.filters)):
            raise ValueError(f"unknown filters: {', '.join(unknown)}")
        rows = self.rows
        for name, value in asked.items():
            if value is not None:
                rows = self.filters[name](rows, value)
        if behind is not None:
            if len(behind) != len(self.keys):
                raise ValueError(f"a place has {len(self.keys)} values")
            *lead, last = self.keys
            *values, end = behind
            rows = rows.where((F.col(self.keys[0]) >= F.lit(behind[0])) & after([(k, True) for k in lead], values, last, end))  # the first part reaches the scan
        cut = rows.orderBy(*self.keys).limit(limit + 1)
        turn, n = F.row_number().over(W.orderBy(*self.keys)), F.count(F.lit(1)).over(W.partitionBy())
        page = cut.withColumns({"_turn": turn, "has_more": n > limit}).where(F.col("_turn") <= limit).drop("_turn")
        return self.details(page) if self.details else page


@dataclass(frozen=True)
class Group:
    """A dataset to search: rows with id and name, further texts that count, the policy that grants it."""

    rows: DataFrame
    policy: str
    also: tuple[str, ...] = ()


def grouped_search(spark: SparkSession, groups: Mapping[str, Group], asked: str, granted: Sequence[str], limit: int = 10) -> DataFrame:
    """dataset, policy, granted, returned, place, id, name: the first rows of each group; one row with nulls for a group without any.

    Order: names equal to the query, then those that start with it, then the rest; by length, name and id. Datasets whose
    policy is not granted are named, but not read.
    """
    if not asked.strip():
        raise ValueError("the query is empty")
    text = asked.lower()
    found, heads = None, []
    for place, (name, g) in enumerate(groups.items()):
        heads.append((place, name, g.policy, g.policy in granted))
        if g.policy not in granted:
            continue
        low = F.lower("name")
        keep = low.contains(text)
        for more in g.also:
            keep = keep | F.coalesce(F.lower(more).contains(text), F.lit(False))
        order: list[Column] = [F.when(low == text, 0).when(low.startswith(text), 1).otherwise(2), F.char_length("name"), F.col("name"), F.col("id")]
        top = g.rows.where(F.coalesce(keep, F.lit(False))).withColumn("_o", F.struct(*order)).orderBy("_o").limit(limit)
        top = top.select(F.lit(name).alias("dataset"), F.row_number().over(W.orderBy("_o")).alias("place"), F.col("id").cast("string").alias("id"), "name")
        found = top if found is None else found.unionByName(top)
    head = spark.createDataFrame(heads, "_g int, dataset string, policy string, granted boolean").coalesce(1)
    if found is None:
        found = spark.createDataFrame([], "dataset string, place int, id string, name string")
    n = F.count("id").over(W.partitionBy("dataset"))
    return head.join(found, "dataset", "left").select("dataset", "policy", "granted", n.alias("returned"), "place", "id", "name")
