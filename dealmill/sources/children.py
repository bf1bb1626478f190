"""Rows that belong to parents, replaced parent by parent: a new set of children takes the place of the old one whole.

Rows lie in buckets of parents. A change writes the touched buckets anew beside the old ones and then a manifest that
names the current folder of every bucket; readers follow the newest manifest, so a change that stopped before its
manifest never was. Manifests are numbered and never overwritten: of two writers at a time one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checked(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rows with ``error``: the names of the rules that a row breaks, or null. A rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("error", F.when(F.size(broken) > 0, F.array_join(broken, ", ")))


class Children:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, parent: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.parent, self.buckets = spark, folder.rstrip("/"), schema, parent, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))

    def _manifest(self, number: int) -> dict[str, str]:
        """Folder of each bucket."""
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{number}.json", wholetext=True).first()[0])

    def _swap(self, number: int, folders: dict[str, str]) -> None:
        made = self._path(f"{self.folder}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(made)
        out.write(json.dumps(folders).encode())
        out.close()
        name = self._path(f"{self.folder}/manifests/{number}.json")
        if self._fs.exists(name) or not self._fs.rename(made, name):
            self._fs.delete(made, False)
            raise RuntimeError("another writer changed these rows; try again")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.parent), F.lit(self.buckets)).cast("int")

    def _read(self, folders: Mapping[str, str]) -> DataFrame:
        paths = sorted(folders.values())
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows.select(*self.schema.names)

    def read(self) -> DataFrame:
        """The rows as of the newest manifest."""
        numbers = self._manifests()
        return self._read(self._manifest(numbers[-1]) if numbers else {})

    def _write(self, rows: DataFrame, touched: list[int], old: dict[str, str], number: int) -> None:
        made = f"{self.folder}/rows/{number}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(made)
        at = self._path(made)
        there = {s.getPath().getName().removeprefix("_bucket=") for s in self._fs.listStatus(at) if s.isDirectory()}
        folders = {b: f for b, f in old.items() if int(b) not in touched} | {b: f"{made}/_bucket={b}" for b in there}
        self._swap(number, folders)

    def _now(self) -> tuple[int, dict[str, str]]:
        numbers = self._manifests()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {})

    def replace(self, batch: DataFrame, version: str | None = None) -> None:
        """Each parent of ``batch`` gets the batch's children in place of its own; other parents keep theirs.

        With ``version`` only parents whose version in the batch is above all that is stored are promoted. Reads and
        writes the buckets of the batch's parents. Children of a null parent are refused.
        """
        if batch.where(F.col(self.parent).isNull()).limit(1).count():
            raise ValueError("a child has no parent")
        batch = batch.select(*self.schema.names)
        number, old = self._now()
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]  # buckets at most
        before = self._read({b: f for b, f in old.items() if int(b) in touched})
        parents = batch.groupBy(self.parent).agg(*([F.max(version).alias("_new")] if version else [F.lit(1).alias("_new")]))
        if version:
            stored = before.groupBy(self.parent).agg(F.max(version).alias("_old"))
            parents = parents.join(stored, self.parent, "left").where(F.col("_old").isNull() | (F.col("_new") > F.col("_old")))
            batch = batch.join(parents.select(self.parent), self.parent, "left_semi")
        self._write(before.join(parents.select(self.parent), self.parent, "left_anti").unionByName(batch), touched, old, number + 1)

    def store(self, batch: DataFrame, rules: Mapping[str, Column], version: str | None = None) -> None:
        """replace() with the rows that break no rule; the others are added to the folder ``errors`` with what they break.

        A parent all of whose rows are bad keeps its children.
        """
        told = checked(batch, rules)
        told.where("error IS NOT NULL").write.mode("append").parquet(f"{self.folder}/errors")
        self.replace(told.where("error IS NULL").drop("error"), version)

    def purge(self, gone: Column) -> None:
        """Removes the rows of which ``gone`` is true, from the buckets that hold any."""
        number, old = self._now()
        rows = self._read(old)
        touched = [r[0] for r in rows.where(gone).select(self._bucket()).distinct().collect()]
        if touched:
            kept = self._read({b: f for b, f in old.items() if int(b) in touched}).where(~F.coalesce(gone, F.lit(False)))
            self._write(kept, touched, old, number + 1)

    def drop_older(self, keep: int = 1) -> None:
        """Removes all but the newest manifests, and the folders that none of those names."""
        numbers = self._manifests()
        used = {f.rsplit("/", 1)[0] for n in numbers[-keep:] for f in self._manifest(n).values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{n}.json"), False)
        at = self._path(f"{self.folder}/rows")
        for s in self._fs.listStatus(at) if self._fs.exists(at) else ():
            if f"{self.folder}/rows/{s.getPath().getName()}" not in used:
                self._fs.delete(s.getPath(), True)
