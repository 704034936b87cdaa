"""Connected components by alternating large-star and small-star steps, without gathering any neighbourhood.

Defined results: edges with a null end are ignored, loops and repeated edges don't matter, no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import forget, materialize

HUBS = 10_000


def _star(edges: DataFrame, both: bool, size: int) -> DataFrame:
    """Hook neighbours to a vertex's least neighbour: the larger ones (large star) or the smaller ones (small star)."""
    if both:
        e = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c")).withColumnRenamed("u", "k")
    # hubs have at least an HUBS-th of all edges, so there are 2 * HUBS of them at most; their edges aren't shuffled
    hub = F.col("c") * HUBS >= size
    hubs, rest = F.broadcast(least.where(hub).drop("c")), least.where(~hub).drop("c")
    near = e.join(hubs, F.col("u") == F.col("k"), "left")
    far = near.where("k IS NULL").select("u", "v").join(rest, F.col("u") == F.col("k"))
    hooked = near.where("k IS NOT NULL").select("u", "v", "k", "m").union(far.select("u", "v", "k", "m"))
    least = least.drop("c")
    hooked = hooked.where("v > u").select("v", "m") if both else hooked.select("v", "m").union(least.select("k", "m"))
    return hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every vertex of the edges (a, b) the least vertex of its component."""
    now = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "cc-edges")  # nulls fail the comparison
    seen, size = None, now.count()
    while True:
        half = materialize(_star(now, True, size), "cc-edges")
        after = materialize(_star(half, False, size), "cc-edges")
        forget(half)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if tuple(mark) == seen or not mark[0]:
            break
        seen, size = tuple(mark), mark[0]
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
