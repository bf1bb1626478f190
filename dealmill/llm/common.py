"""What the operators share: the shared scratch folder, durable cuts of lineage, word patterns."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders named so far: those of the process, then those of each open scope.
_NAMED: list[list[str]] = [[]]
#: Spark's setting: the shuffle files of a statement go when it ends, not when the driver next collects its garbage.
_FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII white space separates words: space and \t \n \v \f \r.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; it goes with its scope.

    Where the setting is absent, a session on one machine gets a folder for temporary files, and any other fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints", "dealmill")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _NAMED[-2 if outer and len(_NAMED) > 1 else -1].append(path)
    return path


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a cut of lineage that outlives executors.

    With ``outer`` the files outlive the scope they were written in. The shuffle files of the write are freed with
    it, for whatever comes later reads the Parquet files.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name, outer), spark.conf.get(_FREES_SHUFFLES)
    spark.conf.set(_FREES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREES_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a frame made by materialize(), once nothing reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope: folders named inside are removed at its end, but for those written with ``outer``."""
    _NAMED.append([])
    try:
        yield
    finally:
        for folder in _NAMED.pop():
            _delete(spark, folder)


def settled(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query (spark, ...) whose rows are written once; what it wrote on its way is removed."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        with scratch(spark):
            return materialize(query(spark, *args), query.__name__, outer=True)

    return run


def drop_scratch(spark: SparkSession) -> None:
    """Removes all folders that this process has named, once all results are written elsewhere."""
    for folders in _NAMED:
        while folders:
            _delete(spark, folders.pop())


def join_spread(rows: DataFrame, facts: DataFrame, on: str | list[str], by: list[str], how: str = "inner", parts: int = 512) -> DataFrame:
    """rows joined with facts (at most one row for each key) where one key may hold a large share of the rows.

    Rows of a key are dealt to ``parts`` parts by a digest of ``by``, each part gets its own copy of the fact, and
    the join is on key and part. A part that no row has gets none, so there are never more copies than rows.
    """
    keys = [on] if isinstance(on, str) else on
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)))
    return dealt.join(dealt.select(*keys, "_part").distinct().join(facts, keys), [*keys, "_part"], how).drop("_part")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays. Texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def count_spaced_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time: what a Python worker makes of them stays small, and freed memory goes back."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        pa.default_memory_pool().release_unused()
