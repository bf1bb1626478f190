"""A corpus pipeline of four stages, each by an operator of dealmill.llm.

Every stage takes all its predecessor kept, written as Parquet and read again. The first three return the
columns of documents; the last returns what the mix takes of each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmill.llm.common import drop_written, materialize, scratch
from dealmill.llm.decontam import decontaminate
from dealmill.llm.mixing import mix_sources
from dealmill.llm.neardup import near_duplicates
from dealmill.llm.toxicity import fitted_model, keep_harmless

#: Stages draw on learned weights and hashing that SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that tells their rows apart: doc_id itself, or a written row number."""
    repeated = docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
    if repeated.limit(1).count() == 0:
        return docs, "doc_id"
    name = "_row"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _ids(rows: DataFrame, key: str, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ids that ``judge`` returns for rows (doc_id, text), written once; what it wrote on its way is removed."""
    with scratch(rows.sparkSession):
        return materialize(judge(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key)), "judged", outer=True)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts stay."""
    return keep_harmless(docs, fitted_model(docs, sf_dir))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows with null or repeated ids are told apart by a row number; null and wordless texts stay, each by itself.
    """
    rows, key = _identified(docs)
    copies = _ids(rows, key, lambda texts: near_duplicates(texts).where(~F.col("kept")))  # fewer than those that stay
    return rows.join(copies, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and wordless texts stay."""
    rows, key = _identified(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    leaks = _ids(rows, key, lambda texts: decontaminate(texts, items, slop=None).where("contaminated"))
    return rows.join(leaks, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, source, size, source_size, target, taken, for documents of which it takes words."""
    with scratch(spark):
        return materialize(mix_sources(docs).where(F.col("taken") > 0), "mixed", outer=True)


STAGES = [("toxicity", toxicity), ("near_duplicate", near_duplicate), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages write is removed as soon as the next stage has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
        if before is not None:
            drop_written(before)
        before = docs
    return docs
