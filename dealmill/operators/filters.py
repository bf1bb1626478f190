"""Predicate builders: Columns from validated requests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def contains(col: Column, value: str) -> Column:
    """Case-insensitive contains; % and _ of the value are wildcards."""
    return col.ilike(f"%{value}%")


def equals(col: Column, value: str) -> Column:
    return F.lower(col) == F.lit(value.lower())


@dataclass(frozen=True)
class Scalar:
    """Include any of, exclude all of; excluded columns keep their nulls."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exact: bool = False

    def on(self, col: Column) -> Column:
        one = equals if self.exact else contains
        keep = any_of([one(col, v) for v in self.include]) if self.include else F.lit(True)
        for v in self.exclude:
            keep = keep & (col.isNull() | ~one(col, v))
        return keep


@dataclass(frozen=True)
class Dates:
    """Half-open: from gte up to and including the day lte."""

    gte: dt.date | None = None
    lte: dt.date | None = None

    def __post_init__(self):
        if self.gte and self.lte and self.gte > self.lte:
            raise ValueError("gte is after lte")

    def on(self, col: Column) -> Column:
        keep = F.lit(True)
        if self.gte:
            keep = keep & (col >= F.lit(self.gte).cast("timestamp_ntz"))
        if self.lte:
            keep = keep & (col < F.lit(self.lte + dt.timedelta(days=1)).cast("timestamp_ntz"))
        return keep

    def overlaps(self, start: Column, end: Column) -> Column:
        """Active at some time of the range; an open end is active for ever."""
        keep = F.lit(True)
        if self.lte:
            keep = keep & (start < F.lit(self.lte + dt.timedelta(days=1)).cast("timestamp_ntz"))
        if self.gte:
            keep = keep & (end.isNull() | (end >= F.lit(self.gte).cast("timestamp_ntz")))
        return keep


UNITS = {"thousand": 1e-3, "million": 1.0, "billion": 1e3}


@dataclass(frozen=True)
class Money:
    """A range in millions; amounts in other units are converted; currencies and missing values by policy."""

    gte: float | None = None
    lte: float | None = None
    currencies: tuple[str, ...] = ("USD",)
    missing: str = "exclude"

    def __post_init__(self):
        if self.missing not in ("exclude", "include_as_unknown", "require_known"):
            raise ValueError(f"unknown policy {self.missing!r}")

    def on(self, amount: Column, unit: Column, currency: Column) -> Column:
        factor = reduce(lambda c, u: c.when(F.lower(unit) == u, F.lit(UNITS[u])), UNITS, F.when(F.lit(False), F.lit(0.0)))
        millions = amount * factor
        known = millions.isNotNull() & currency.isin(*self.currencies)
        if self.missing == "require_known":
            return known
        inside = known
        if self.gte is not None:
            inside = inside & (millions >= self.gte)
        if self.lte is not None:
            inside = inside & (millions <= self.lte)
        inside = F.coalesce(inside, F.lit(False))
        return inside | ~F.coalesce(known, F.lit(False)) if self.missing == "include_as_unknown" else inside


@dataclass(frozen=True)
class Related:
    """Any / all / exclude over a many-to-many bridge: one pass over the bridge gives a flag for each value."""

    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exact: bool = True

    def apply(self, facts: DataFrame, bridge: DataFrame, key: str, value: str) -> DataFrame:
        one = equals if self.exact else contains
        flags = {f"f{i}": v for i, v in enumerate([*self.any, *self.all, *self.exclude])}
        if not flags:
            return facts
        hits = bridge.groupBy(key).agg(*[F.bool_or(F.coalesce(one(F.col(value), v), F.lit(False))).alias(f) for f, v in flags.items()])
        names = list(flags)
        a, b = len(self.any), len(self.any) + len(self.all)
        has = lambda f: F.coalesce(F.col(f), F.lit(False))
        keep = any_of([has(f) for f in names[:a]]) if a else F.lit(True)
        for f in names[a:b]:
            keep = keep & has(f)
        for f in names[b:]:
            keep = keep & ~has(f)
        return facts.join(hits, key, "left").where(keep).drop(*names)
