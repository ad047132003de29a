"""The same questions on streams: counts that grow with new files, windows and sessions of event time.

Extensions: batch is the reference semantics. Each function takes a streaming DataFrame and gives one, so any
source and sink fit; run_available runs one over all files there are, with a checkpoint, and returns the table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators.metrics import confusion, rates
from windrow.storage import remember, shared_dir

#: Files taken up in one step of a stream.
FILES = 16


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file or folder of files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def windowed(events: DataFrame, time: str, length: str, slide: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Count and sum per sliding window of event time and keys; state older than the watermark is dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = "1 hour") -> DataFrame:
    """Rows of a key at most gap apart as one session.

    Rows behind the watermark are dropped, in complete mode too; with late None there is no watermark and all rows count, in
    any order, while the state keeps all sessions.
    """
    s = (events.withWatermark(time, late) if late else events).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def running_confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates that are updated with every file of results."""
    return rates(predictions.groupBy(*keys).agg(*confusion()))


def run_available(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return what it made, as a table in the shared folder."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/windrow-stream/{name}-{uuid.uuid4().hex}"

    remember(at, spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/table")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/table")
