"""Merging entities: redirects that chain, fields filled from the entities that go, references carried along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmill.session import written


def resolved(redirects: DataFrame) -> DataFrame:
    """id, root, depth: where each redirected id (id, into) ends, and over how many steps.

    Each round doubles the steps that all ids have taken (pointer jumping), so chains of length n take log2(n) joins.
    An id may be redirected once; itself, nulls and repeated rows are left out. Cycles and ids with two targets are
    refused.
    """
    steps = redirects.where("id IS NOT NULL AND into IS NOT NULL AND id <> into").select("id", "into").distinct()
    steps = written(steps.select("id", F.col("into").alias("root"), F.lit(1).cast("long").alias("depth")), "redirects")
    seen = steps.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).first()
    if seen["n"] != seen["ids"]:
        raise ValueError("an id is redirected to two targets")
    longest = 1
    while True:
        onward = steps.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        jumped = steps.join(onward, F.col("root") == F.col("_id"), "left")
        left = jumped.agg(F.count("_id").alias("n")).first()["n"]
        if not left:
            return steps
        if longest > seen["n"]:
            raise ValueError("redirects form a cycle")
        longest *= 2
        moved = jumped.select("id", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        steps = written(moved, "redirects")


def merged(entities: DataFrame, redirects: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The entities that stay, each null field filled from those merged into it: the nearest step first, then the smallest key.

    An entity that many others go into is filled by partial aggregates, not in one task. Roots that are no entities
    come to be with the fields of what was merged into them.
    """
    steps = resolved(redirects)
    placed = entities.join(steps.select(F.col("id").alias(key), "root", "depth"), key, "left")
    order = F.struct(F.coalesce("depth", F.lit(0)), F.col(key))
    rows = placed.select(F.coalesce("root", key).alias(key), order.alias("_order"), *fields)
    return rows.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_order"))).alias(f) for f in fields])


def carried(references: DataFrame, redirects: DataFrame, key: str) -> DataFrame:
    """References (bridge rows) with each redirected key replaced by its root; rows that become equal stay once."""
    steps = resolved(redirects).select(F.col("id").alias("_id"), "root")
    to: Column = F.coalesce("root", key)
    return references.join(steps, F.col(key) == F.col("_id"), "left").select(*[to.alias(key) if c == key else F.col(c) for c in references.columns]).distinct()
