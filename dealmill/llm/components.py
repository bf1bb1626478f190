"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.llm.common import drop_written, join_spread, materialize

PARTS = 256


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (its smallest id) for every id that occurs in ``edges`` (a, b: long, undirected).

    Each round every node takes the smallest label among its own, its neighbours' and its label's label, so
    chains shorten by half; rounds end when no label changes. Labels are written to the shared folder after each
    round. The edges of a hub, and the members of a large component, are dealt to up to ``PARTS`` parts, each with
    its copy of the hub's label, so none of them meets in one task. An empty table gives no rows.
    """
    both = edges.select("a", "b").where(F.col("a") != F.col("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS))), "edges")
    seats = materialize(both.select("b", "part").distinct(), "seats")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"), "labels")
    for _ in range(rounds):
        told = seats.join(labels.withColumnRenamed("id", "b"), "b")
        around = both.join(told, ["b", "part"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(around, labels["id"] == around["a"]).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        moved = join_spread(hooked, jump, "component", ["id"], parts=PARTS)
        moved = materialize(moved.select("id", "was", F.least("component", "beyond").alias("component")), "labels")
        changed = moved.where(F.col("was") != F.col("component")).limit(1).count()
        drop_written(labels)
        labels = moved.select("id", "component")
        if not changed:
            drop_written(both)
            drop_written(seats)
            return labels
    raise RuntimeError("components did not settle")
