"""Running a streaming query to the end of what is there, with its result as Parquet."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from dealmill.catalog import SCHEMAS
from dealmill.session import delete, scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which processors with timers and maps need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A table as a file stream."""
    return (
        spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs ``stream`` over all input there is and returns what it put out.

    Append writes each batch once; complete replaces the last state by each batch's. What the run kept for a restart goes.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).outputMode(mode)
    out = f"{path}/out"
    with keyed_state(spark):
        if mode == "append":
            running = writer.format("parquet").option("path", out).start()
        else:
            running = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
        running.awaitTermination()
    delete(spark, f"{path}/_checkpoint")
    return spark.read.schema(stream.schema).parquet(out)
