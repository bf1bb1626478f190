"""A lossless archive of raw responses: each content once, each fetch of it as a small row of its own.

A fetch of a content that is known bumps when it was last seen by one row in the ledger; bodies are written once and
never again. Bodies go first: a run that stops between the two leaves a body that no fetch names, which a later run
finds known; a run that is repeated adds nothing that counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmill.operators.topk import first_per_key

BODIES = "source string, id string, sha256 string, body string"
FETCHES = "source string, id string, sha256 string, fetched_at timestamp_ntz"
KEYS = ["source", "id", "sha256"]


class Archive:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def add(self, responses: DataFrame) -> None:
        """Takes responses (source, id, body, fetched_at); further columns are left out.

        A null body is an answer without content and is kept as such. Rows without source, id or time can't be found
        again and raise. Only digests are compared with the archive; its bodies are not read.
        """
        rows = responses.select(F.col("source").cast("string"), F.col("id").cast("string"), F.col("body").cast("string"), F.col("fetched_at").cast("timestamp_ntz"))
        for c in ("source", "id", "fetched_at"):
            rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a response has no {c}")).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
        rows = rows.withColumn("sha256", F.coalesce(F.sha2(F.col("body").cast("binary"), 256), F.lit("")))
        known = self._read("bodies", BODIES).select(*KEYS)
        rows.join(known, KEYS, "left_anti").dropDuplicates(KEYS).select(*KEYS, "body").write.mode("append").parquet(f"{self.folder}/bodies")
        rows.select(*KEYS, "fetched_at").distinct().write.mode("append").parquet(f"{self.folder}/fetches")

    def contents(self) -> DataFrame:
        """source, id, sha256, first_fetched, last_fetched, fetches (different times): each content that was ever answered."""
        seen = self._read("fetches", FETCHES).groupBy(*KEYS)
        return seen.agg(F.min("fetched_at").alias("first_fetched"), F.max("fetched_at").alias("last_fetched"), F.countDistinct("fetched_at").alias("fetches"))

    def current(self, asof: str | None = None) -> DataFrame:
        """source, id, sha256, fetched_at: the newest content of each record, at a time if given; of equal times the larger digest."""
        seen = self._read("fetches", FETCHES)
        if asof is not None:
            seen = seen.where(F.col("fetched_at") <= F.lit(asof).cast("timestamp_ntz"))
        return first_per_key(seen, ["source", "id"], [F.desc("fetched_at"), F.desc("sha256")])

    def bodies(self, wanted: DataFrame) -> DataFrame:
        """The wanted rows (source, id, sha256 and others) with their bodies, each once."""
        once = self._read("bodies", BODIES).dropDuplicates(KEYS)  # two writers at a time can both add one
        return wanted.join(once, KEYS, "left")
