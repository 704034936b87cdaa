"""Titles and authors from the first pages of a book. Gates and expressions are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import strip


def page_lines(pages: DataFrame, most_pages: int, most_lines: int = 15) -> DataFrame:
    """(source, page_idx, i, line): the first non-blank lines of the first pages."""
    first = pages.where(F.col("page_idx") < most_pages)
    kept = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    return first.select("source", "page_idx", F.posexplode(F.slice(kept, 1, most_lines)).alias("i", "line"))


def titles(pages: DataFrame) -> DataFrame:
    """(source, title): the line with the highest priority; earlier pages and lines win ties. What a pattern finds in a
    page's text has priority 0 and stands before the page's lines."""
    rows = page_lines(pages, 5)
    whole = pages.where("page_idx < 5").select("source", "page_idx", F.array_join(F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != ""), " ").alias("t")).where("t <> ''")
    tries = F.concat(*[F.transform(F.regexp_extract_all("t", F.lit(x), F.lit(1)), lambda m, i: F.struct(F.lit(k).alias("k"), i.alias("i"), strip(m).alias("title"))) for k, x in enumerate(P.TITLE_PATTERNS)])
    by_pattern = whole.select("source", "page_idx", F.explode(tries).alias("x"))
    low_ = F.lower("x.title")
    by_pattern = by_pattern.where((F.length("x.title") >= 5) & ~F.col("x.title").rlike(r"^\d") & ~F.contains(low_, F.lit("chapter")) & ~F.contains(low_, F.lit("page")) & ~low_.startswith("by"))
    by_pattern = by_pattern.select("source", F.col("x.title").alias("line"), F.struct(F.lit(0).alias("p"), "page_idx", F.lit(-1).alias("i"), F.col("x.k").alias("k"), F.col("x.i").alias("j")).alias("o"))
    n, low = F.length("line"), F.lower("line")
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    gates = (
        n.between(10, 80) & ~low.rlike(r"^(page|chapter|\d+|©|copyright|isbn|by\s+)")
        & (F.regexp_count("line", F.lit(r"[^a-zA-Z\s]")) <= n * 0.4) & (F.regexp_count("line", F.lit(r"\d")) <= n * 0.2)
        & F.col("line").rlike(r"(?:^|\s)\p{Lu}") & ~F.col("line").endswith(".") & spaces.between(1, 8)
    )
    capitals = (F.upper("line") == F.col("line")) | F.col("line").rlike(r"^\P{L}*\p{Lu}\p{Ll}*(?:\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$")
    priority = 10 - F.col("i") + F.when(F.contains(low, F.lit("story")), 10).otherwise(0) + F.when(F.contains(low, F.lit("memoir")), 8).otherwise(0) + F.when(capitals, 5).otherwise(0)
    found = rows.where(gates).select("source", "line", F.struct((-priority).alias("p"), "page_idx", "i", F.lit(0).alias("k"), F.lit(0).alias("j")).alias("o"))
    return found.unionByName(by_pattern).groupBy("source").agg(F.min_by("line", "o").alias("title"))


def authors(pages: DataFrame) -> DataFrame:
    """(source, author): the first match by page, line and pattern; Unknown Author without one."""
    rows = page_lines(pages, 3)
    rx = [r"(?i)by\s+([a-zA-Z\s.]+)", r"(?i)author[:\s]+([a-zA-Z\s.]+)", r"(?i)^([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)$"]
    tries = F.array(*[strip(F.regexp_extract("line", x, 1)) for x in rx])
    fit = F.filter(tries, lambda x: F.length(x).between(5, 50) & ~x.rlike(r"\d"))
    found = rows.select("source", F.get(fit, F.lit(0)).alias("author"), F.struct("page_idx", "i").alias("o"))
    g = found.groupBy("source").agg(F.min_by("author", F.when(F.col("author").isNotNull(), F.col("o"))).alias("author"))
    return pages.select("source").distinct().join(g, "source", "left").select("source", F.coalesce("author", F.lit("Unknown Author")).alias("author"))

