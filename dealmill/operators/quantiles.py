"""Exact quantiles of large groups: equal values are counted first, then ranked range by range; no task holds a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of values are cut by a fixed logarithmic scale, so that a range is the same whenever it is computed.
_PER_E_FOLD = 256


def _range_of(value: Column) -> Column:
    """A whole number that never falls as the value rises; some 0.4 % of the value apart."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * _PER_E_FOLD)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys of which null equals null; the keys come once, from a."""
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(b, on, how).drop(*[f"_r_{k}" for k in keys])


def _counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))


def _ranked(counted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    rows = counted.where(F.col(value).isNotNull()).withColumn("_range", _range_of(F.col(value)))
    group = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy(*keys, "_range").agg(F.sum("_c").alias("_c")).select(*keys, "_range", before.alias("_before"), F.sum("_c").over(group).alias("n"))
    own = F.sum("_c").over(W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    placed = same_keys(rows.withColumn("_own", own), ranges, [*keys, "_range"])
    last = F.col("_before") + F.col("_own")
    return placed.select(*keys, value, F.col("_c").alias("count"), (last - F.col("_c") + 1).alias("first"), last.alias("last"), "n")


def ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """*keys, value, count, first, last, n: each known value of a group once, with the ranks (from 1) that it takes.

    Equal values are counted before they are shuffled. A rank is the number of rows in the group's ranges before,
    plus the place in its own range. Nulls have no rank; a null key is a group of its own.
    """
    return _ranked(_counted(df, keys, value), keys, value)


def at_rank(value: str, place: Column) -> Column:
    """Aggregate over ranked(): the value at a rank."""
    return F.max(F.when((F.col("first") <= place) & (place <= F.col("last")), F.col(value)))


def interpolated(value: str, q: float) -> Column:
    """Aggregate over ranked(): the continuous quantile, between the two values around it."""
    at = F.lit(q) * (F.col("n") - 1)
    low, high = at_rank(value, F.floor(at) + 1), at_rank(value, F.ceil(at) + 1)
    part = F.max(at - F.floor(at))
    return low + (high - low) * part


def quantiles(df: DataFrame, keys: Sequence[str], value: str, of: dict[str, float], finish: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """*keys and the named continuous quantiles of ``value``."""
    return ranked(df, keys, value).groupBy(*keys).agg(*[finish(interpolated(value, q)).alias(name) for name, q in of.items()])


def described(df: DataFrame, keys: Sequence[str], value: str, of: dict[str, float], finish: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """*keys, rows, known, total, mean, least, most and the named quantiles: one shuffle of counted values serves all."""
    counted = _counted(df, keys, value)
    v = F.col(value)
    totals = counted.groupBy(*keys).agg(
        F.sum("_c").alias("rows"), F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_c"))), F.lit(0)).alias("known"), F.sum(v * F.col("_c")).alias("total"),
        (F.sum(v * F.col("_c")) / F.sum(F.when(v.isNotNull(), F.col("_c")))).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"),
    )
    places = _ranked(counted, keys, value).groupBy(*keys).agg(*[finish(interpolated(value, q)).alias(name) for name, q in of.items()])
    return same_keys(totals, places, keys, "left")
