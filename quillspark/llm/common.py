"""Helpers that the training-data operators share: durable scratch tables and SQL text idioms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode, where all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that weren't written elsewhere are lost with them."""
    forget(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch: int = 1000) -> DataFrame:
    """Cut lineage with a table written to the shared folder, which outlives any executor. While it is written, Python
    functions get at most `batch` rows at once, since rows may hold whole texts or more."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame | str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for x in frames:
        path = x if isinstance(x, str) else x._scratch
        spark = SparkSession.active()
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's sizes of a frame's sources, added up: for file scans the size of the files. Sources of unknown size,
    for which it assumes more than a petabyte, count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 50)


def small_enough(df: DataFrame, mb: int = 16) -> bool:
    """Whether a frame made from scratch tables or files of at most `mb` MB can be broadcast; measured, not assumed."""
    return input_bytes(df) <= mb << 20


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame | None:
    """(row, text, rid) where ids are repeated or null: rows under numbers of their own, in order of id (null last), text and
    all columns, in a scratch table; None where each row has an id of its own."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("doc_id IS NULL OR c > 1")
    if odd.isEmpty():
        return None
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    rows = rows.orderBy(F.col("row.doc_id").asc_nulls_last(), F.xxhash64("text"), F.to_json("row"))
    return materialize(rows.select("row", "text", F.monotonically_increasing_id().alias("rid")), name)


def blocks_for(df: DataFrame, mb: int = 8) -> int:
    """So many blocks that each holds about `mb` MB of the source files, never fewer than the shuffle partitions."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // (mb << 20)))


def bucket_labels(spark: SparkSession, buckets: int) -> list[int]:
    """A number for each of some buckets that Spark's hash puts into a partition of its own, so that tasks get like shares;
    beyond 100,000 buckets chance is even enough, and the numbers are 0, 1, 2 ..."""
    if buckets > 100_000:
        return list(range(buckets))
    found: dict[int, int] = {}
    at, size = 0, 16 * buckets
    while len(found) < buckets:
        rows = spark.range(at, at + size).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets)).alias("p")).groupBy("p").agg(F.min("k").alias("k"))
        for r in rows.collect():  # a row per bucket
            found.setdefault(r["p"], r["k"])
        at += size
    return [found[i] for i in range(buckets)]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of single-byte characters take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def spaced(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters; null and empty texts have none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD)
    return F.filter(parts, lambda w: w != "")
