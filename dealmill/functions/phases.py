"""Development phases: rank, highest phase, and phases of archived XML records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phases with their source ids and ranks; terminal statuses rank below all active ones.
PHASES = (
    ("no development reported", "NDR", 0), ("discovery", "DR", 10), ("preclinical", "PC", 20), ("clinical", "CU", 25), ("phase 1 clinical", "C1", 30), ("phase 2 clinical", "C2", 40),
    ("phase 3 clinical", "C3", 50), ("pre-registration", "PR", 60), ("registered", "R", 70), ("launched", "L", 80), ("discontinued", "DX", -10), ("suspended", "S", -10), ("withdrawn", "W", -10),
)
UNKNOWN = -20
_PHASE = "struct<_VALUE: string, _id: string>"
RECORD = f"Drugs struct<Drug: array<struct<_id: string, DrugNameDisplay: string, PhaseHighestStart: {_PHASE}, PhaseHighestNow: {_PHASE}>>>"


def phase_rank(name: Column, phase_id: Column | None = None) -> Column:
    """By id where the source gives a known one, else by name."""
    by_name = F.create_map(*[F.lit(x) for n, _, r in PHASES for x in (n, r)])
    found = F.coalesce(by_name[F.lower(F.trim(name))], F.lit(UNKNOWN))
    if phase_id is None:
        return found
    by_id = F.create_map(*[F.lit(x) for _, i, r in PHASES for x in (i, r)])
    return F.coalesce(by_id[F.upper(F.trim(phase_id))], found)


def highest_phase(name: Column, phase_id: Column | None = None) -> Column:
    """Aggregate: the furthest phase; of equal ranks the last by name. Empty names don't count; without any it is null."""
    named = F.trim(name)
    return F.max_by(named, F.when(named != "", F.struct(phase_rank(name, phase_id), F.lower(named))))


def drug_phases(records: DataFrame, key: str, xml: str) -> DataFrame:
    """key, drug_id, name, start, start_id, now, now_id: one row for each drug of each archived XML record."""
    parsed = records.select(key, F.from_xml(xml, RECORD).alias("r"))
    drugs = parsed.select(key, F.explode("r.Drugs.Drug").alias("d")).withColumn("drug_id", F.expr("try_cast(d._id AS BIGINT)")).where(F.col("drug_id").isNotNull())
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    return drugs.select(
        key, "drug_id", F.trim(F.coalesce("d.DrugNameDisplay", F.lit(""))).alias("name"),
        told(F.col("d.PhaseHighestStart._VALUE")).alias("start"), told(F.upper("d.PhaseHighestStart._id")).alias("start_id"),
        told(F.col("d.PhaseHighestNow._VALUE")).alias("now"), told(F.upper("d.PhaseHighestNow._id")).alias("now_id"),
    )


def deal_phases(drugs: DataFrame, key: str) -> DataFrame:
    """key, at_start, now: a deal's highest phases over its drugs."""
    of = lambda c: highest_phase(F.coalesce(c, F.lit("")), F.coalesce(f"{c}_id", F.lit("")))
    return drugs.groupBy(key).agg(of("start").alias("at_start"), of("now").alias("now"))
