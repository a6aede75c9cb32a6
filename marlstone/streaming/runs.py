"""Streams run to the end of what is there, results written to a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, folder_: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder_}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder_)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote; in complete mode, what it wrote last. Its state is in
    RocksDB; other streams of the session keep their own provider (a query takes its settings up when it starts)."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).outputMode(mode)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", f"{at}/out").start()
        else:
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def windowed_counts(events: DataFrame, column: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, column, n) in tumbling windows with a watermark."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), column).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), column, "n")
