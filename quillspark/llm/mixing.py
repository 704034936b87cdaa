"""Mixing sources to target weights by systematic sampling.

Each document expects `target / source_size` copies. Within a source the expected copies are summed along an order of
the documents, one random offset is added, and a document is emitted once per integer boundary that its stretch of the
sum crosses. The order is an organ pipe by size (small, large, small), so that neighbours along the sum have like
sizes and the words taken stay close to the target.

Ranks come from counts per (source, size, salt), so no task holds a whole source: a document's rank is the count of
all cells before its own plus its place in its cell.

Defined results: null text has size 0; a null source is a source of its own, last in order; sources without words get
target 0 and nothing is taken; rows of repeated or null ids are separate documents, each with a decision of its own: they
are numbered first, in order of id, text and all columns; other columns may have any name; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, numbered, table

WEIGHTS = (5, 2, 1)
SALTS = 64
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling under the cap `most` x size.

    Sources sorted by cap over weight fill up first; the level is where what is left, spread by weight, no longer
    exceeds the next cap. One row per source, so the windows hold as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_fill = Window.orderBy(F.col("cap") * F.lit(1.0) / F.col("w"), "pos")
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    num, den = share
    s = (
        sizes.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("left2", F.sum("source_size").over(everything) * num - den * F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        # capped exactly when the level left at its turn reaches its cap
        .withColumn("capped", F.col("w") * F.col("left2") >= F.col("cap") * F.col("w_left") * den)
    )
    open_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level_num", F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") * F.lit(1.0) / F.col("w"), -F.col("pos"), "left2", "w_left"))).over(open_))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("level_num.left2")).cast("double") / (F.col("level_num.w_left") * den).cast("double")
    )
    return s.select("source", "source_size", target.alias("target"))


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A random offset in [0, 1) of 20 bits, fixed by seed and source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0null")))), 1, 5), 16, 10).cast("long") / F.lit(1048576.0)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: str = SEED, salts: int = SALTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each document."""
    rows = numbered(docs, "mix-rows")
    if rows is not None:
        docs = rows.select("row.doc_id", "row.source", "text", "rid")
    return plan_rows(docs, "doc_id" if rows is None else "rid", weights, share, most, seed, salts).drop("rid")


def plan_rows(docs: DataFrame, key: str, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: str = SEED, salts: int = SALTS) -> DataFrame:
    """The plan of rows that `key` tells apart, which is column `rid` of it."""
    digest = F.md5(F.col(key).cast("string"))
    salt = F.pmod(F.ascii(F.substring(digest, 1, 1)) * 16 + F.ascii(F.substring(digest, 2, 1)), F.lit(salts)).cast("int")
    sized = materialize(docs.select("doc_id", F.col(key).alias("rid"), "source", size_of(F.col("text")).alias("size"), salt.alias("salt")), "mix-sizes")
    before = Window.partitionBy("c_source").orderBy(F.desc("c_size"), "c_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        sized.groupBy(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("salt").alias("c_salt")).agg(F.count("*").alias("n"))
        .select("c_source", "c_size", "c_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("c_source")).alias("n_docs"))
    )
    totals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "t_source")
    place = Window.partitionBy("source", "size", "salt").orderBy("rid")
    ranked = sized.withColumn("k", F.row_number().over(place) - 1).join(
        cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("salt") == F.col("c_salt"))
    ).select("doc_id", "rid", "source", "size", (F.col("start") + F.col("k")).alias("rank"), "n_docs")
    joined = ranked.join(totals, F.col("source").eqNullSafe(F.col("t_source")))
    mid = F.expr("(n_docs - 1) div 2")
    pos = F.when(F.col("rank") % 2 == 0, mid - F.expr("rank div 2")).otherwise(mid + F.expr("(rank + 1) div 2"))
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size").cast("double"))
    joined = joined.withColumns({"pos": pos, "rate": rate, "u": offset_of(F.col("source"), seed)})
    crossed = F.floor(F.col("u") + F.col("rate") * (F.col("pos") + 1)) - F.floor(F.col("u") + F.col("rate") * F.col("pos"))
    copies = F.greatest(F.lit(0), F.least(crossed, F.lit(most)))
    return joined.select("doc_id", "rid", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the plan says, with all its columns."""
    rows = numbered(docs, "mix-rows")
    if rows is None:
        plan = plan_rows(docs, "doc_id", **options)
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"))
    else:
        plan = plan_rows(rows.select("row.doc_id", "row.source", "text", "rid"), "rid", **options)
        rows = rows.select("row", F.col("rid").alias("id"))
    out = rows.join(plan.where("copies > 0").select("rid", "copies"), F.col("id") == F.col("rid"))
    return out.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the plan over a relation of documents' columns."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (ascii(substr(md5(CAST(doc_id AS VARCHAR)), 1, 1)) * 16 + ascii(substr(md5(CAST(doc_id AS VARCHAR)), 2, 1))) % {SALTS} AS salt
  FROM {docs}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s0),
s2 AS (SELECT *, CASE pos % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER f, 0) AS left2,
              sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS w_left
       FROM s2 WINDOW f AS (ORDER BY cap * 1.0::DOUBLE / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, w * left2 >= cap * w_left * 2 AS capped FROM s3),
lvl AS (SELECT left2, w_left FROM s4 WHERE NOT capped ORDER BY cap * 1.0::DOUBLE / w, pos LIMIT 1),
totals AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
    ELSE (w * (SELECT left2 FROM lvl))::DOUBLE / ((SELECT w_left FROM lvl) * 2)::DOUBLE END AS target FROM s4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, salt, doc_id) - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS n_docs FROM sized),
placed AS (SELECT r.*, t.source_size, t.target,
    CASE WHEN rank % 2 = 0 THEN (n_docs - 1) // 2 - rank // 2 ELSE (n_docs - 1) // 2 + (rank + 1) // 2 END AS pos,
    CASE WHEN t.source_size = 0 THEN 0::DOUBLE ELSE t.target / t.source_size::DOUBLE END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(r.source, chr(0) || 'null')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM ranked r JOIN totals t ON r.source IS NOT DISTINCT FROM t.source),
planned AS (SELECT doc_id, size, source_size, target,
    CAST(greatest(0, least(floor(u + rate * (pos + 1)) - floor(u + rate * pos), 2)) AS BIGINT) AS copies FROM placed)
"""


ORACLE = mix_sql() + "SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM planned"
