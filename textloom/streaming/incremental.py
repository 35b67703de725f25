"""Operators over streams of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str = "text", ts_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Documents whose key hasn't been seen within the watermark: the state that other tools keep in a filter file."""
    return stream.withColumn("_k", F.md5(F.col(key).cast("string"))).withWatermark(ts_col, late).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def windowed_counts(stream: DataFrame, by: list[str], ts_col: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each group and window of time."""
    return stream.withWatermark(ts_col, late).groupBy(F.window(ts_col, size), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def mix_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that applies a batch operator to each batch of new files and appends its rows as Parquet.

    A batch is written under its number, so that one repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
