"""Criteria over the child rows of facts: many EXISTS tests in one aggregation.

Child rows say something about a fact: its assets, companies, dated events, payments. Each criterion becomes flags on
child rows; rows without any flag are left out at the scan, the flags of a fact are joined by OR before and behind one
shuffle, and the facts meet them once, however many criteria a request has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmill.operators.filters import Dates, Scalar, any_of, contains, equals


@dataclass(frozen=True)
class Evidence:
    """What a child row tells of one kind: by which source, under which names or id, with a refinement, number or time."""

    kind: str
    source: str
    names: tuple[Column, ...] = ()
    id: Column | None = None
    refinement: Column | None = None
    number: Column | None = None
    at: Column | None = None
    where: Column | None = None


@dataclass(frozen=True)
class Child:
    """Rows with the key of a fact, and the evidence that lies in their columns."""

    rows: DataFrame
    evidence: tuple[Evidence, ...]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Criterion:
    """A kind of evidence and the sources that may give it: None for all; with none at all nothing is ever found."""

    kind: str
    sources: tuple[str, ...] | None = None

    def _rows(self, e: Evidence) -> Column | None:
        """The condition under which a row is such evidence; None if it never is."""
        if e.kind != self.kind or (self.sources is not None and e.source not in self.sources):
            return None
        return F.lit(True) if e.where is None else e.where

    def _over(self, child: Child, test) -> Column | None:
        found = [(e, ok) for e in child.evidence if (ok := self._rows(e)) is not None]
        return any_of([_true(ok & test(e)) for e, ok in found]) if found else None

    def tests(self) -> list:
        """For each flag, a function from evidence to a condition."""
        raise NotImplementedError

    def flags(self, child: Child) -> list[Column | None]:
        return [self._over(child, t) for t in self.tests()]

    def keep(self, flags: list[Column]) -> Column:
        raise NotImplementedError

    def needs_a_row(self) -> bool:
        """Facts without any flag can't pass."""
        raise NotImplementedError


@dataclass(frozen=True)
class Named(Criterion):
    """Any, all and none of some names or ids. ``ids`` stand beside ``any`` and are compared as they are.

    A refinement (a role, an action) holds for the row that has the name, not for another row of the fact.
    """

    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    exact: bool = False
    refinement: Scalar = field(default_factory=Scalar)

    def tests(self) -> list:
        one = equals if self.exact else contains
        refined = lambda e: F.lit(True) if e.refinement is None else self.refinement.on(e.refinement)
        by_name = lambda v: lambda e: any_of([_true(one(n, v)) for n in e.names]) & refined(e)
        by_id = lambda v: lambda e: (F.lit(False) if e.id is None else _true(e.id == F.lit(v))) & refined(e)
        return [*map(by_name, (*self.any, *self.all, *self.exclude)), *map(by_id, self.ids)]

    def keep(self, flags: list[Column]) -> Column:
        a, b, c = len(self.any), len(self.any) + len(self.all), len(self.any) + len(self.all) + len(self.exclude)
        choice = flags[:a] + flags[c:]
        out = any_of(choice) if choice else F.lit(True)
        for f in flags[a:b]:
            out = out & f
        return out & ~any_of(flags[b:c])

    def needs_a_row(self) -> bool:
        return bool(self.any or self.all or self.ids)


@dataclass(frozen=True)
class Companies(Criterion):
    """Companies named by id or by name, not both, each with roles if any; every one of ``several`` must take part."""

    several: tuple[tuple[str | None, str | None, tuple[str, ...]], ...] = ()

    def __post_init__(self):
        if any((i is None) == (n is None) for i, n, _ in self.several):
            raise ValueError("a company is given by an id or by a name, not by both")

    def tests(self) -> list:
        def one(company_id, name, roles):
            part = Named(self.kind, self.sources, ids=(company_id,)) if name is None else Named(self.kind, self.sources, any=(name,))
            return lambda e: part.tests()[0](e) & (F.lit(True) if not roles else F.lit(False) if e.refinement is None else e.refinement.isin(*roles))

        return [one(*c) for c in self.several]

    def keep(self, flags: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, flags, F.lit(True))

    def needs_a_row(self) -> bool:
        return bool(self.several)


@dataclass(frozen=True)
class Between(Criterion):
    """A number of the kind lies in the range. ``unknown`` keeps facts that have no row of the kind at all."""

    gte: float | None = None
    lte: float | None = None
    unknown: bool = False

    def __post_init__(self):
        if self.gte is not None and self.lte is not None and self.gte > self.lte:
            raise ValueError("gte is above lte")

    def tests(self) -> list:
        def inside(e):
            out = F.lit(e.number is not None)
            if self.gte is not None:
                out = out & (e.number >= self.gte)
            if self.lte is not None:
                out = out & (e.number <= self.lte)
            return out

        return [inside, lambda e: F.lit(True)] if self.unknown else [inside]

    def keep(self, flags: list[Column]) -> Column:
        return flags[0] | ~flags[1] if self.unknown else flags[0]

    def needs_a_row(self) -> bool:
        return not self.unknown


@dataclass(frozen=True)
class During(Criterion):
    """Some row of the kind is dated within the days."""

    days: Dates = field(default_factory=Dates)

    def tests(self) -> list:
        return [lambda e: F.lit(False) if e.at is None else e.at.isNotNull() & self.days.on(e.at)]

    def keep(self, flags: list[Column]) -> Column:
        return flags[0]

    def needs_a_row(self) -> bool:
        return True


def flagged(key: str, children: Sequence[Child], criteria: Sequence[Criterion]) -> tuple[DataFrame | None, list[list[str]]]:
    """One row for each fact that has a flag, and the names of each criterion's flags.

    A child without evidence for any criterion isn't read. Null keys belong to no fact.
    """
    names = [[f"_c{i}_{j}" for j in range(len(c.tests()))] for i, c in enumerate(criteria)]
    every = [n for ns in names for n in ns]
    parts = None
    for child in children:
        found = {n: f for c, ns in zip(criteria, names, strict=True) for n, f in zip(ns, c.flags(child), strict=True)}
        if not any(f is not None for f in found.values()):
            continue
        rows = child.rows.select(F.col(key), *[(F.lit(False) if found[n] is None else found[n]).alias(n) for n in every])
        rows = rows.where(F.col(key).isNotNull() & any_of([F.col(n) for n in every if found[n] is not None]))
        parts = rows if parts is None else parts.unionByName(rows)
    return (None if parts is None else parts.groupBy(key).agg(*[F.bool_or(n).alias(n) for n in every])), names


def satisfying(facts: DataFrame, key: str, children: Sequence[Child], criteria: Sequence[Criterion]) -> DataFrame:
    """The facts that satisfy all criteria, each once for each of its rows; columns as they are."""
    if not criteria:
        return facts
    hits, names = flagged(key, children, criteria)
    if hits is None:
        flags = {n: F.lit(False) for ns in names for n in ns}
        return facts.where(reduce(lambda a, b: a & b, [c.keep([flags[n] for n in ns]) for c, ns in zip(criteria, names, strict=True)]))
    kept = reduce(lambda a, b: a & b, [c.keep([_true(F.col(n)) for n in ns]) for c, ns in zip(criteria, names, strict=True)])
    if any(c.needs_a_row() for c in criteria):  # then nothing without a flag can stay, and the flags are judged before the join
        return facts.join(hits.where(kept).select(key), key, "left_semi")
    return facts.join(hits.where(~kept).select(key), key, "left_anti")  # without a flag all is kept


def told_by(key: str, children: Sequence[Child], wanted: dict[str, Criterion]) -> DataFrame:
    """key, told: which of the named criteria found something, sorted by name."""
    hits, names = flagged(key, children, list(wanted.values()))
    if hits is None:
        raise ValueError("no child has evidence of these kinds")
    told = F.array_compact(F.array(*[F.when(any_of([F.col(n) for n in ns]), F.lit(w)) for w, ns in sorted(zip(wanted, names, strict=True))]))
    return hits.select(key, told.alias("told"))
