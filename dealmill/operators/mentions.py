"""Entities named in texts and in lists of names: longest aliases first, clear cases apart from unclear ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmill.operators.text_index import tokens

_MATCH = "array<struct<at: int, len: int, alias: string>>"


def mentions(texts: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, alias, status, entities: the aliases that stand in each text, from left to right, longest first, none inside another.

    ``aliases`` has entity, alias and canonical (whether it is the entity's own name). Words are runs of letters and
    digits, case aside; ``at`` counts words from 0. A mention is exact where one entity has it as its own name,
    plausible where one entity has it as another name, ambiguous else; several entities of which one has the name as
    its own are an exact mention of that one. Repeated keys and null texts are allowed; texts without mentions have no rows.

    Aliases are dealt by their first word: a place in a text looks its word up, and only where aliases begin with it
    are word sequences built, of the lengths that these aliases have.
    """
    named = aliases.where("entity IS NOT NULL").select("entity", F.coalesce("canonical", F.lit(False)).alias("canonical"), tokens(F.col("alias")).alias("words")).where(F.size("words") > 0)
    named = named.select("entity", "canonical", F.array_join("words", " ").alias("alias"), F.size("words").alias("len"), F.col("words")[0].alias("first"))
    lengths = named.groupBy("first").agg(F.collect_set("len").alias("lengths"))  # a few whole numbers a word
    own = named.groupBy("alias", "entity").agg(F.bool_or("canonical").alias("canonical"))
    told = own.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.count_if("canonical").alias("n_own"), F.min("entity").alias("any"), F.min(F.when(F.col("canonical"), F.col("entity"))).alias("own"))

    rows = texts.select(F.monotonically_increasing_id().alias("_row"), key, tokens(F.col(text)).alias("words")).where(F.size("words") > 0)
    reach = aliases.agg(F.coalesce(F.max(F.size(tokens(F.col("alias")))), F.lit(1))).first()[0] or 1
    ahead = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("first"), F.slice("words", i + 1, F.lit(reach)).alias("ahead")))
    placed = rows.select("_row", key, F.explode(ahead).alias("p")).select("_row", key, "p.*").join(lengths, "first")
    tried = placed.select("_row", key, "at", F.explode(F.filter("lengths", lambda n: n <= F.size("ahead"))).alias("len"), "ahead")
    tried = tried.select("_row", key, "at", "len", F.array_join(F.slice("ahead", F.lit(1), F.col("len")), " ").alias("alias"))
    found = tried.join(told.select("alias"), "alias", "left_semi")
    longest = found.groupBy("_row", key, "at").agg(F.max_by(F.struct("len", "alias"), "len").alias("m"))
    listed = longest.groupBy("_row", key).agg(F.array_sort(F.collect_list(F.struct("at", "m.len", "m.alias"))).cast(_MATCH).alias("all"))

    def kept(out: Column, m: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        free = last.isNull() | (last["at"] + last["len"] <= m["at"])
        return F.when(free, F.concat(out, F.array(m))).otherwise(out).cast(_MATCH)

    clear = listed.select(key, F.explode_outer(F.aggregate("all", F.array().cast(_MATCH), kept)).alias("m")).select(key, "m.at", "m.alias")
    status = F.when(F.col("n_own") == 1, "exact").when((F.col("n") == 1), "plausible").otherwise("ambiguous")
    entity = F.when(F.col("n_own") == 1, F.col("own")).when(F.col("n") == 1, F.col("any"))
    return clear.join(told, "alias").select(key, "at", "alias", status.alias("status"), entity.alias("entity"), F.when(status == "ambiguous", F.col("n")).otherwise(F.lit(1)).cast("long").alias("entities"))


def plain_key(name: Column) -> Column:
    """Letters and digits alone, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", ""))


def linked(names: DataFrame, aliases: DataFrame, least: float, unique: bool) -> DataFrame:
    """subject, role, name, entity, alias, confidence: names (subject, role, name) that equal an alias (entity, alias, confidence) in letters and digits.

    Aliases below the confidence ``least`` do not count; with ``unique`` neither do those of several entities. Of
    equal aliases of an entity the surest is given, then the first. A name that is listed twice is linked once.
    """
    sure = aliases.where(F.col("confidence") >= least).select("entity", "alias", "confidence", plain_key(F.col("alias")).alias("k")).where("k <> '' AND entity IS NOT NULL")
    best = sure.groupBy("k", "entity").agg(F.max("confidence").alias("confidence"), F.min_by("alias", F.struct(-F.col("confidence"), F.col("alias"))).alias("alias"))
    if unique:
        alone = best.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("k")
        best = best.join(alone, "k", "left_semi")
    asked = names.where("name IS NOT NULL").select("subject", "role", F.trim("name").alias("name")).distinct().withColumn("k", plain_key(F.col("name")))
    return asked.join(best, "k").select("subject", "role", "name", "entity", "alias", "confidence")
