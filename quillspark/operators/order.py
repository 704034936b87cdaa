"""Places and running values along a key's order, without a task per key: rows are dealt over ranges of the order, each range is
ordered by itself, and what the ranges before (or after) hold is carried in from one small row per key and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 16


def ranges_for(rows: DataFrame, each: int = RANGE_ROWS) -> int:
    """So many ranges that each holds about `each` rows, 4096 at most. Rows are counted, since the optimizer's size of joined
    rows is the product of both sides."""
    return max(1, min(4096, -(-rows.count() // each)))


def range_of(value: Column, cuts: list[float]) -> Column:
    """The number of cuts below a value, by halving; null values are in the first range."""
    if not cuts:
        return F.lit(0)
    among, number = F.lit(cuts), value.cast("double")
    halves = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda a, h: F.when(F.get(among, a + h - 1) < number, a + h).otherwise(a))


def cuts_of(rows: DataFrame, column: str, parts: int) -> list[float]:
    """Values that part a numeric column into about equal ranges."""
    if parts <= 1:
        return []
    found = rows.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted(set(found))


def numbered(rows: DataFrame, key: str, order: str, name: str, parts: int | None = None) -> DataFrame:
    """`rows` with their place from 0, in a column `name`, among the rows of their key in the order of a numeric column that is
    unique within the key. The result does not depend on `parts`. Rows are exchanged once, so they should be narrow."""
    cuts = cuts_of(rows, order, parts or ranges_for(rows.select(order)))
    if not cuts:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    dealt = rows.withColumn("range_", range_of(F.col(order), cuts))
    before = Window.partitionBy(key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = dealt.groupBy(key, "range_").agg(F.count("*").alias("c_")).select(key, "range_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("start_"))
    along = Window.partitionBy(key, "range_").orderBy(F.col("start_").isNull(), order)  # a range's count of rows before it comes first
    both = dealt.withColumn("start_", F.lit(None).cast("long")).unionByName(counts, allowMissingColumns=True)
    start = F.max("start_").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumns({name: F.row_number().over(along) - 2, "from_": start}).where("start_ IS NULL")
    return out.withColumn(name, F.col(name) + F.col("from_").cast("int")).drop("range_", "start_", "from_")


def least_from(rows: DataFrame, asked: DataFrame, key: str, at: str, value: str, parts: int | None = None) -> DataFrame:
    """`asked` (with `key` and a numeric `at`) with the least `value` among the key's rows at `at` or above, null without one.
    `rows` are read some times over."""
    cuts = cuts_of(rows, at, parts or ranges_for(rows))
    columns = asked.columns
    here = rows.select(F.col(key), F.col(at), F.col(value), F.lit(None).cast(asked.select(F.struct("*").alias("s")).schema["s"].dataType).alias("ask_"))
    there = asked.select(F.col(key), F.col(at), F.lit(None).cast(rows.schema[value].dataType).alias(value), F.struct("*").alias("ask_"))
    both = here.unionByName(there).withColumns({"range_": range_of(F.col(at), cuts), "first_": F.lit(1)})
    if cuts:
        after = Window.partitionBy(key).orderBy(F.desc("range_")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        least = both.groupBy(key, "range_").agg(F.min(value).alias("m_"))
        carried = least.select(key, "range_", F.min("m_").over(after).alias(value), F.lit(0).alias("first_"))
        both = both.unionByName(carried, allowMissingColumns=True)
    along = Window.partitionBy(key, "range_").orderBy("first_", F.desc(at), F.col("ask_").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn(value, F.min(value).over(along)).where("ask_ IS NOT NULL")
    return out.select(*[F.col(f"ask_.{c}").alias(c) for c in columns], value)
