"""A voice catalog that follows arriving profiles: an upsert by name that may be repeated at any point.

Each batch of profiles is written as one delta, under the batch's number, so that a batch that runs again overwrites its own
rows and nothing else. The catalog is what the deltas say of each name last; `compact` folds the deltas up to a number into a
base. Neither reads a catalog into the driver or rewrites it for a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "name string, quality double, created string, clips int"
DELTA = "name string, quality double, created string, clips int, first_batch long, batch long, at long"


def delta_of(profiles: DataFrame, number: int) -> DataFrame:
    """A batch's profiles with defaults for missing fields; of a name that occurs in it more than once the best by time of
    creation, then quality and clips, counts. Profiles without a name, which name no entry, are left out."""
    rows = profiles.where("name IS NOT NULL").select("name", F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce("created", F.lit("")).alias("created"), F.coalesce("clips", F.lit(0)).alias("clips"))
    last = rows.groupBy("name").agg(F.max(F.struct("created", "quality", "clips")).alias("x"))
    here = F.lit(number).cast("long")
    return last.select("name", "x.quality", "x.created", "x.clips", here.alias("first_batch"), here.alias("batch"), here.alias("at"))


def upsert(profiles: DataFrame, number: int, catalog: str) -> None:
    """Write a batch's delta; the same number overwrites it."""
    delta_of(profiles, number).drop("at").write.mode("overwrite").parquet(f"{catalog}/at={number}")


def folded(rows: DataFrame) -> DataFrame:
    """One row per name: the values of its last delta, the batch it came in first."""
    g = rows.groupBy("name").agg(F.max(F.struct("batch", "quality", "created", "clips")).alias("x"), F.min("first_batch").alias("first_batch"))
    return g.select("name", "x.quality", "x.created", "x.clips", "first_batch", "x.batch")


def read_catalog(spark: SparkSession, catalog: str) -> DataFrame:
    """(name, quality, created, clips, first_batch, batch), best first by quality where order matters. A base covers the deltas up
    to its own number, whether they are still there or not: folding a row twice changes nothing."""
    return folded(spark.read.schema(DELTA).option("basePath", catalog).parquet(catalog))


def compact(spark: SparkSession, catalog: str, upto: int) -> None:
    """Fold the deltas up to `upto` into a base below all of them. The deltas themselves may be deleted afterwards, or stay."""
    rows = spark.read.schema(DELTA).option("basePath", catalog).parquet(catalog).where(F.col("at") <= upto)
    folded(rows).write.mode("overwrite").parquet(f"{catalog}.base-{upto}")
    base = spark.read.parquet(f"{catalog}.base-{upto}")
    base.write.mode("overwrite").parquet(f"{catalog}/at={-1 - upto}")


def refresh(spark: SparkSession, source: str, catalog: str, checkpoint: str, files: int | None = None):
    """Take all profiles (JSON, one a line) that have arrived in a folder since the last time; returns the finished query."""
    rows = spark.readStream.schema(PROFILE)
    rows = rows.option("maxFilesPerTrigger", files) if files else rows
    q = rows.json(source).writeStream.foreachBatch(lambda batch, number: upsert(batch, number, catalog)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
