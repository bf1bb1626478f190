"""Claims over a hierarchy of places: what a claim says about each place, with its evidence; and dossiers by section."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.operators.quantiles import same_keys


def ancestry(hierarchy: DataFrame, levels: int = 8) -> DataFrame:
    """place, above, steps: every place with itself (0 steps) and all places it lies in, from (place, within).

    A hierarchy is a dimension of few levels; deeper places than ``levels`` see that many above them.
    """
    up = hierarchy.where("within IS NOT NULL").select(F.col("place").alias("above"), "within").distinct()
    places = hierarchy.select("place").unionByName(hierarchy.select(F.col("within").alias("place"))).where("place IS NOT NULL").distinct()
    reached = found = places.select("place", F.col("place").alias("above"), F.lit(0).alias("steps"))
    for n in range(1, levels + 1):
        reached = reached.join(up, "above").select("place", F.col("within").alias("above"), F.lit(n).alias("steps"))
        found = found.unionByName(reached)
        if not reached.limit(1).count():
            break
    return found.groupBy("place", "above").agg(F.min("steps").alias("steps"))


def evidence_sets(rows: DataFrame, keys: Sequence[str], evidence: str, most: int = 20) -> DataFrame:
    """*keys, n_evidence, evidence: how many different pieces a group has, and the ``most`` smallest, sorted."""
    each = rows.where(F.col(evidence).isNotNull()).select(*keys, evidence).distinct()
    counts = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_evidence"))
    first = each.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(evidence))).where(F.col("_n") <= most)
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(evidence)).alias("evidence"))
    return same_keys(counts, listed, keys)


def scopes(claims: DataFrame, places: DataFrame, above: DataFrame, most: int = 20) -> DataFrame:
    """claim, place, scope, via, conflict, n_evidence, evidence: what claims say about places.

    ``claims`` (claim, place, excluded, evidence) speak of a place and all that lies in it; ``above`` is ancestry().
    The nearest place that a claim speaks of decides; there an exclusion goes before an inclusion, and ``conflict``
    tells that it holds both, here or farther up with the opposite word. Places that a claim is silent on have no row.
    Evidence is that of the deciding place and word. Claims are counted by (claim, place, word) before they are spread
    over the places below, so a place of many claims stays small.
    """
    said = claims.where("claim IS NOT NULL AND place IS NOT NULL AND excluded IS NOT NULL")
    words = said.groupBy("claim", F.col("place").alias("above"), "excluded").agg(F.count(F.lit(1)).alias("_n"))
    spread = words.join(above.join(places.select("place").distinct(), "place"), "above")
    decided = spread.groupBy("claim", "place").agg(
        F.min_by(F.struct("above", "excluded", "steps"), F.struct("steps", (~F.col("excluded")).cast("int"), "above")).alias("_by"), (F.count_distinct("excluded") > 1).alias("conflict")
    )
    by = decided.select("claim", "place", "conflict", F.col("_by.above").alias("via"), F.col("_by.excluded").alias("excluded"), F.col("_by.steps").alias("steps"))
    proof = evidence_sets(said.withColumnRenamed("place", "via"), ["claim", "via", "excluded"], "evidence", most)
    word = F.when(F.col("excluded"), "excluded").otherwise("included")
    scope = F.when(F.col("steps") == 0, F.concat(F.lit("explicitly_"), word)).otherwise(F.concat(word, F.lit("_via_"), F.lower("via")))
    told = same_keys(by, proof, ["claim", "via", "excluded"], "left")
    return told.select("claim", "place", scope.alias("scope"), "via", "conflict", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "evidence")


def dossiers(links: DataFrame, subject: str, sections: Mapping[str, tuple[Column, Column, Column]], limit: int = 50, hot: int = 1_000_000) -> DataFrame:
    """subject, section, place, id, links, last, of: the newest entries of each section of each subject.

    ``sections`` gives (id, when, condition) of a section over the rows of ``links``. Links are dealt out by subject
    once, one row each; what follows is done where they lie, all sections together. Subjects with more than ``hot``
    links, which are counted first, go another way, where no task has all of one: their entries are summed by
    (subject, section, id) and cut before those of a section meet. ``of`` is how many entries the section has;
    ``limit`` of them are given, by last date and id.
    """
    links = links.where(F.col(subject).isNotNull())
    often = [r[0] for r in links.groupBy(subject).count().where(F.col("count") > hot).select(subject).collect()]
    if not often:
        return _told(_entries(links.repartition(subject), subject, sections), limit)
    is_hot = F.col(subject).isin(*often)
    summed = _entries(links.where(is_hot), subject, sections)
    counts = summed.groupBy("subject", "section").agg(F.count(F.lit(1)).alias("of"))
    hot_ones = _first(summed, limit).join(counts, ["subject", "section"])
    return _told(_entries(links.where(~is_hot).repartition(subject), subject, sections), limit).unionByName(hot_ones)


def _entries(links: DataFrame, subject: str, sections: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    """subject, section, id, links, last: links summed by the entries they make."""
    tagged = F.array(*[F.struct(F.lit(name).alias("section"), i.cast("string").alias("id"), at.alias("at"), keep.alias("keep")) for name, (i, at, keep) in sections.items()])
    entries = links.select(F.col(subject).alias("subject"), F.explode(tagged).alias("e")).where(F.col("e.keep") & F.col("e.id").isNotNull())
    return entries.groupBy("subject", "e.section", "e.id").agg(F.count(F.lit(1)).alias("links"), F.max("e.at").alias("last"))


def _first(summed: DataFrame, limit: int) -> DataFrame:
    order = W.partitionBy("subject", "section").orderBy(F.desc_nulls_last("last"), "id")
    return summed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def _told(summed: DataFrame, limit: int) -> DataFrame:
    """The first entries with the number of all, counted beside them."""
    return _first(summed.withColumn("of", F.count(F.lit(1)).over(W.partitionBy("subject", "section"))), limit)
