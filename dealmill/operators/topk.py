"""Rows per key, stable pages and rank fusion."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in the given total order (DISTINCT ON). Partial limits run before the shuffle."""
    name = rank or "_rank"
    kept = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def keyset_page(df: DataFrame, key: str, after=None, limit: int = 50) -> DataFrame:
    """The next ``limit`` rows by ascending key, with ``has_more``: one row more is read, none is counted."""
    rows = df.where(F.col(key) > F.lit(after)) if after is not None else df
    page = rows.orderBy(F.col(key).asc()).limit(limit + 1)
    n = F.count(F.lit(1)).over(W.partitionBy())
    r = F.row_number().over(W.orderBy(key))
    return page.withColumn("has_more", n > limit).withColumn("_r", r).where(F.col("_r") <= limit).drop("_r")


class Cursor:
    """Opaque multi-key cursors: place in a total order, bound to the request that made them. Nulls sort last."""

    VERSION = 1

    @classmethod
    def encode(cls, request: str, values: Sequence, row_id: int) -> str:
        return base64.urlsafe_b64encode(json.dumps({"v": cls.VERSION, "request": request, "values": list(values), "id": row_id}, separators=(",", ":")).encode()).decode()

    @classmethod
    def decode(cls, text: str, request: str) -> tuple[list, int]:
        try:
            got = json.loads(base64.urlsafe_b64decode(text.encode()))
            if got["v"] != cls.VERSION or got["request"] != request or not isinstance(got["values"], list):
                raise ValueError
            return got["values"], got["id"]
        except (ValueError, KeyError, TypeError):
            raise ValueError("the cursor does not belong to this request") from None


def after(keys: Sequence[tuple[str, bool]], values: Sequence, id_col: str, row_id) -> Column:
    """Rows behind (values, row_id) in the order of ``keys`` (name, ascending), nulls last, then ascending id."""
    out = F.col(id_col) > F.lit(row_id)
    for (name, ascending), value in reversed(list(zip(keys, values, strict=True))):
        col = F.col(name)
        if value is None:  # only nulls are left
            out = col.isNull() & out
        else:
            beyond = col > F.lit(value) if ascending else col < F.lit(value)
            out = beyond | col.isNull() | ((col == F.lit(value)) & out)
    return out


def ordered(keys: Sequence[tuple[str, bool]], id_col: str) -> list[Column]:
    return [F.col(k).asc_nulls_last() if a else F.col(k).desc_nulls_last() for k, a in keys] + [F.col(id_col).asc()]


def reciprocal_ranks(lists: Sequence[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """id, score: sum of 1 / (k + rank) over ranked lists (id, rank); ties by id."""
    union = lists[0].select("id", "rank")
    for more in lists[1:]:
        union = union.unionByName(more.select("id", "rank"))
    fused = union.groupBy("id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 8).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(limit)


def interleave(sources: Sequence[DataFrame], limit: int) -> DataFrame:
    """Round robin over ranked sources (id, score): first of each, then second of each, up to ``limit`` rows."""
    parts = None
    for place, df in enumerate(sources):
        cut = df.select("id", "score").orderBy(F.desc("score"), "id").limit(limit)  # so that the numbering below is over few rows
        one = cut.select(F.lit(place).alias("source"), F.col("id"), F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("turn"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.orderBy("turn", "source").limit(limit)
