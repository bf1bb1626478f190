"""Bounded breadth-first search. Each step's frontier is written once; nothing is held in a cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.operators.topk import first_per_key
from dealmill.session import delete, scratch


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distances(edges: DataFrame, start: Sequence[str], max_hops: int) -> DataFrame:
    """id, hops of all vertices within max_hops edges. Each step joins the frontier and leaves out who was met."""
    spark = edges.sparkSession
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    folder = scratch(spark, "distances")
    seen = frontier = _stored(spark.createDataFrame([(s, 0) for s in start], "id string, hops int").distinct(), f"{folder}/hops-0")
    for hop in range(1, max_hops + 1):
        step = frontier.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct()
        frontier = _stored(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)), f"{folder}/hops-{hop}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, start: Sequence[str], max_hops: int) -> DataFrame:
    """The edges both of whose ends are within max_hops of a start."""
    near = distances(edges, start, max_hops).select("id")
    ends = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi")
    return ends.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def shortest_chains(members: DataFrame, a: str, b: str, max_steps: int, limit: int = 5) -> DataFrame:
    """path (array of ids): the first ``limit`` of the shortest chains from a to b, in the order of "a>...>b".

    members (group, id): who stands in which group; neighbours in a chain share one. The search starts at b. A vertex
    is met first by its shortest chains, of which only the first ``limit`` are kept: as they have one length and end
    alike, no other can be among the first of a later vertex. A group is opened once, by the first of its members that
    is met, so pairs of members are never listed, and hubs cost ``limit`` rows.
    """
    spark = members.sparkSession
    folder = scratch(spark, "chains")
    rows = members.select("group", "id").where(F.col("group").isNotNull() & F.col("id").isNotNull())
    line = F.array_join("path", ">")
    frontier = _stored(spark.createDataFrame([(b, [b])], "id string, path array<string>"), f"{folder}/met-0")
    met, opened = frontier.select("id"), None
    found = frontier.where(F.col("id") == a)
    for step in range(1, max_steps + 1):
        if not found.isEmpty() or frontier.isEmpty():
            break
        groups = rows.join(frontier, "id").select("group", "path")
        if opened is not None:
            groups = groups.join(opened, "group", "left_anti")
        groups = _stored(first_per_key(groups.distinct(), ["group"], [line], limit), f"{folder}/opened-{step}")
        opened = groups.select("group").distinct() if opened is None else opened.unionByName(groups.select("group").distinct())
        longer = rows.join(groups, "group").join(met, "id", "left_anti").select("id", F.concat(F.array("id"), "path").alias("path"))
        frontier = _stored(first_per_key(longer.distinct(), ["id"], [line], limit), f"{folder}/met-{step}")
        met = met.unionByName(frontier.select("id").distinct())
        found = frontier.where(F.col("id") == a)
    out = _stored(found.select("path").orderBy(line).limit(limit), scratch(spark, "chains-found"))
    delete(spark, folder)
    return out


def shortest_paths(edges: DataFrame, a: str, b: str, max_hops: int, limit: int = 5) -> DataFrame:
    """path (array of ids): the first ``limit`` of the shortest paths from a to b over undirected edges."""
    ends = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.struct(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).alias("group")).distinct()
    return shortest_chains(ends.select("group", F.explode(F.array("group.x", "group.y")).alias("id")), a, b, max_hops, limit)
