"""Cleaning of page lines: page furniture, repeated lines, lines without letters, stray fragments at page edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import contains_any, lines, strip

# A backtracking engine tries each alternative in place; anchored on both sides once.
MARGINALIA_RX = "^(?:" + "|".join(P.MARGINALIA) + ")$"


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line), from 0."""
    return docs.select(F.col(id_col), F.posexplode(lines(F.coalesce(F.col(text_col), F.lit("")))).alias("line_no", "line"))


def is_marginalia(stripped: Column, case_sensitive: bool = False) -> Column:
    return stripped.rlike(("" if case_sensitive else "(?i)") + MARGINALIA_RX)


def low_quality(text: Column, least: int = 100) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0)) < least


def judge_lines(rows: DataFrame, id_col: str = "doc_id", case_sensitive: bool = False) -> DataFrame:
    """Adds `stripped` and `fate`: blank, marginalia, repeated, symbols, edge or keep, the first that applies."""
    rows = rows.withColumn("stripped", strip(F.col("line")))
    n = F.length("stripped")
    same = Window.partitionBy(id_col, "stripped")
    page = Window.partitionBy(id_col)
    first = F.min("line_no").over(Window.partitionBy(id_col, "line"))
    last = F.max("line_no").over(page)
    repeated = (F.count("*").over(same) >= 2) & (n > 10) & (n < 100)
    symbols = (n > 5) & (F.regexp_count("stripped", F.lit(r"\p{L}")) / n < 0.3)
    edge = ((first < 3) | (first >= last + 1 - 3)) & (n < 5)
    fate = (
        F.when(n == 0, "blank").when(is_marginalia(F.col("stripped"), case_sensitive), "marginalia").when(repeated, "repeated")
        .when(symbols, "symbols").when(edge, "edge").otherwise("keep")
    )
    return rows.withColumn("fate", fate)


def clean_pages(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of cleaned pages, indents cut to 8."""
    judged = judge_lines(rows, id_col).where(F.col("fate").isin("blank", "keep"))
    indent = F.length("line") - F.length(F.regexp_replace("line", r"(?U)^\s+", ""))
    out = F.when(F.col("fate") == "blank", "").otherwise(F.concat(F.repeat(F.lit(" "), F.least(indent, F.lit(8))), "stripped"))
    kept = judged.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("line_no", out.alias("t")))).alias("x"))
    return kept.select(id_col, F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("text"))


def is_rear_matter(title: Column) -> Column:
    return contains_any(F.lower(title), P.REAR_MATTER)
