"""Resumable processing: what a manifest lists as done is skipped, in batch and, as an extension, over a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def pending(work: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return work.join(done.select(on).distinct(), on, "left_anti")


def process_new_files(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Each arriving Parquet file is processed once and appended to `sink`; returns the finished query."""
    def each(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a repeated batch overwrites itself

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
