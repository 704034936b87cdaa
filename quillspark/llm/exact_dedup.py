"""Exact deduplication as a stateful stream.

The stream's keyed state lives in RocksDB on disk and never expires. For each text digest it keeps the digest, the
smallest identifier and that row's content locator (the file it came from), besides a count. Every hit is then checked
on the full bytes of the texts before it counts as a copy.

Defined results: a null text counts as empty; texts are equal when identical after each run of ASCII white space is
replaced by one space; the smallest doc_id of a group stays, null ids last; rows that repeat a doc_id of the same
text, or have none, are one row each in the output, and one row of a group is kept. `deduplicate` keeps, of rows that
share the keeper's id, the first as JSON. Rows that repeat a doc_id with other texts are in groups of their own. An empty
table gives an empty result. Columns of other names are carried through untouched; names may clash with the digest
columns because the operator works on a projection of (id, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import forget, materialize, scratch_path, spaced, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalized(text):
    return spaced(F.coalesce(text, F.lit("")))


def _streamable(docs: DataFrame) -> str | None:
    """The path of a frame that is a plain file scan, as a pattern that matches just that path."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    roots = plan.relation().location().rootPaths()
    path = roots.apply(0).toString() if roots.size() == 1 else None
    return f"{path[:-1]}[{path[-1]}]" if path else None


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """(digest, keep_id, locator, n): one row per distinct digest, from the stream's state.

    `state`: a checkpoint folder to continue from, so that later arrivals meet all that was seen before; a fresh one in
    the shared folder by default.
    """
    spark = docs.sparkSession
    source = _streamable(docs)
    staged = None
    if source is None:
        staged = materialize(docs.select(id_col, text_col), "dedup-source")
        source = f"{staged._scratch[:-1]}[{staged._scratch[-1]}]"
    own = [] if state else [scratch_path(spark, "dedup-state")]
    state = state or own[0]
    out = scratch_path(spark, "dedup-groups")
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        seen = (
            spark.readStream.schema((docs if staged is None else staged).schema).parquet(source)
            .select(F.sha2(normalized(F.col(text_col)), 256).alias("digest"), F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("locator"))
            .groupBy("digest")
            .agg(F.min(F.struct(F.col("id").isNull().alias("absent"), F.col("id"), F.col("locator"))).alias("first"), F.count("*").alias("n"))
            .select("digest", F.col("first.id").alias("keep_id"), F.col("first.locator").alias("locator"), "n")
        )

        def append(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        query = seen.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(append).start()
        query.awaitTermination()
        batches = max((p["batchId"] for p in query.recentProgress), default=-1)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = seen.withColumn("batch", F.lit(0)).schema
    forget(*own, *([staged] if staged is not None else []))
    if batches < 0:
        return spark.createDataFrame([], schema).drop("batch")
    groups = spark.read.schema(schema).parquet(out)
    if batches > 0:  # a key that several batches touched: the last row holds
        groups = groups.groupBy("digest").agg(F.max_by(F.struct("keep_id", "locator", "n"), "batch").alias("g")).select("digest", "g.*")
    groups = groups.drop("batch")
    groups._scratch = out
    return groups


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = True) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Without `once`, all rows with the keeper's id are kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = normalized(F.col("text"))
    groups = digest_groups(docs, id_col, text_col)
    marked = materialize(
        rows.select("doc_id", F.sha2(norm, 256).alias("text_sha256")).join(groups, F.col("text_sha256") == F.col("digest"))
        .select("doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256"),
        "dedup-marked",
    )
    if hasattr(groups, "_scratch"):
        forget(groups)
    # Hits: the texts behind one digest are equal bytes if their least and greatest are. Partial aggregation keeps a hot
    # group to two texts a task.
    hits = marked.where(F.col("group_size") > 1).select(F.col("doc_id").alias("hit"), "text_sha256").distinct()
    texts = rows.select("doc_id", norm.alias("norm")).join(hits, F.col("doc_id").eqNullSafe(F.col("hit")))
    unequal = (
        texts.where(F.sha2("norm", 256) == F.col("text_sha256")).groupBy("text_sha256").agg((F.min("norm") != F.max("norm")).alias("clash"))
        .where("clash").select("text_sha256")
    )
    unequal = materialize(unequal, "dedup-clashes")
    if not unequal.isEmpty():
        apart = (
            rows.select("doc_id", norm.alias("norm"), F.sha2(norm, 256).alias("text_sha256")).join(unequal, "text_sha256")
        )
        true = apart.groupBy("text_sha256", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        fixed = apart.join(true, ["text_sha256", "norm"]).select("doc_id", "keep_id", "group_size", "text_sha256")
        marked = marked.join(unequal, "text_sha256", "left_anti").select(*fixed.columns).unionByName(fixed)
    marked = marked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    if not once:
        return marked
    # rows that share the keeper's id are alike in all columns: they are counted and written anew, so no task holds them all
    again = materialize(marked.where("kept").groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count("*").alias("c")).where("c > 1"), "dedup-again")
    if again.isEmpty():
        return marked
    lost = again.select(F.col("doc_id").alias("a_id"), F.col("text_sha256").alias("a_sha"))
    rest = marked.join(lost, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_sha256") == F.col("a_sha")), "left_anti")
    anew = again.withColumn("i", F.explode(F.expr("sequence(1L, c)")))
    return rest.unionByName(anew.select("doc_id", "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    marked = materialize(mark_duplicates(docs, id_col, text_col, once=False).where("group_size > 1"), "dedup-hits")
    same = lambda x: F.col("id").eqNullSafe(F.col(f"{x}_id")) & (F.col("digest") == F.col(f"{x}_digest"))
    named = lambda d, x: d.select(F.col("doc_id").alias(f"{x}_id"), F.col("text_sha256").alias(f"{x}_digest"))
    norm = normalized(F.col(text_col))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.sha2(norm, 256).alias("digest"))
    rows = rows.join(named(marked.where(~F.col("kept")), "drop").distinct(), same("drop"), "left_anti")
    # keepers whose identifier the group repeats: one row of them stays; as an aggregate, so that no task holds them all
    again = materialize(marked.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("c")).where("c > 1"), "dedup-again")
    if again.isEmpty():
        return rows.select("row.*")
    once = rows.join(named(again, "again"), same("again"), "left_semi").withColumn("norm", normalized(F.col(f"row.{text_col}")))
    once = once.groupBy("id", "norm").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(named(again, "again"), same("again"), "left_anti").select("row.*").unionByName(once.select("row.*"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
