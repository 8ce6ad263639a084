"""Idempotent ingestion: repeated deliveries of a key change nothing, and event time decides the year."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.fiscal import fy_of
from tallybook.operators.relational import one_per_key


def idempotent_sink(target: str, keys: list[str], time: str):
    """A foreachBatch function: appends a row for each key that its fiscal year's folder lacks.

    A key is unique within the fiscal year of its event time, as the years are stores of their own. Of a batch the earliest row of a
    key counts, across batches the one that was delivered first. Only the years of the batch are read from the target.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("fy", fy_of(F.to_date(time)))
        fresh = one_per_key(rows, ["fy", *keys], [F.col(time), *(F.col(k) for k in keys)])
        if _exists(spark, target):
            years = [r.fy for r in rows.select("fy").distinct().collect()]  # a handful at most
            have = spark.read.option("basePath", target).schema(fresh.schema).parquet(target).where(F.col("fy").isin(years))
            fresh = fresh.join(have.select("fy", *keys), ["fy", *keys], "left_anti")
        fresh.write.mode("append").partitionBy("fy").parquet(target)

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], time: str, files_per_batch: int = 1) -> DataFrame:
    """Read all files that are there as a stream, batch by batch, into the target; returns the target."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(idempotent_sink(target, keys, time)).option("checkpointLocation", os.path.join(checkpoint, "ingest")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)


def deduplicated_stream(stream: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Drop repeats of a key that come within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


#: State that outgrows an executor's memory lies in files beside it.
_STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest_keyed(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], time: str, files_per_batch: int = 1) -> DataFrame:
    """Read all files that are there as a stream into the target, one row for each fiscal year and key; returns the target.

    The keys that came before are the stream's state, by fiscal year and key in a state store: a batch costs what it brings, however large the target is. The
    first delivered row of a key counts, of one batch any. A batch that is run again and files that come again change nothing, also after a restart
    from the same checkpoint; the target's own log makes the files of a batch count once.
    """
    before = spark.conf.get(_STATE_STORE[0], None)
    spark.conf.set(*_STATE_STORE)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        fresh = stream.withColumn("fy", fy_of(F.to_date(time))).dropDuplicates(["fy", *keys])
        query = fresh.writeStream.format("parquet").partitionBy("fy").option("path", target).option("checkpointLocation", os.path.join(checkpoint, "keyed")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE[0])
        else:
            spark.conf.set(_STATE_STORE[0], before)
    return spark.read.parquet(target)
