"""Texts for readers: chapter files, the chapter index, the contents report and a voice's notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import bare_title, file_name, strip

RULE = "=" * 50


def chapter_texts(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(source, chapter_no, file, pages, content): chapters (source, chapter_no, title, start_page, end_page, text) with the header
    and the ending of their book (source, title, author); chapters without text have no file."""
    b = books.select("source", F.col("title").alias("book"), "author")
    rows = chapters.where(strip(F.coalesce("text", F.lit(""))) != "").join(b, "source")
    number = F.col("chapter_no").cast("string")
    named = F.concat("book", F.lit(" by "), "author")
    content = F.concat(
        named, F.lit("\n\nChapter "), number, F.lit(": "), "title", F.lit("\n\n"), "text", F.lit("\n\nEnd of Chapter "), number, F.lit(" of "), named, F.lit(".")
    )
    pages = F.concat((F.col("start_page") + 1).cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    return rows.select("source", "chapter_no", "title", file_name(F.col("chapter_no"), F.col("title")).alias("file"), pages.alias("pages"), F.concat(strip(content), F.lit("\n")).alias("content"))


def chapter_index(files: DataFrame) -> DataFrame:
    """(source, report): the index of a book's chapter files (source, chapter_no, title, file, pages[, printed]), in order."""
    printed = F.coalesce("printed", F.lit("N/A")) if "printed" in files.columns else F.lit("N/A")
    entry = F.concat(
        F.lit("Chapter "), F.lpad(F.col("chapter_no").cast("string"), 2, "0"), F.lit(": "), "title", F.lit("\n  File: "), "file", F.lit("\n  Pages: "), "pages", F.lit("\n  Printed Page: "), printed, F.lit("\n")
    )
    g = files.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("chapter_no", entry.alias("e")))).alias("x"))
    lines = F.concat(F.array(F.lit(f"CHAPTER INDEX\n{RULE}\n")), F.transform("x", lambda s: s["e"]))
    return g.select("source", F.concat(strip(F.array_join(lines, "\n")), F.lit("\n")).alias("report"))


def contents_report(entries: DataFrame, books: DataFrame) -> DataFrame:
    """(source, report): a book's (source, title, author, language, breakdown, images) and its entries (source, ord, title,
    page_idx, section), numbered within front, main and rear matter."""
    part = F.when(F.col("section") == "front", 1).when(F.col("section") == "main", 2).otherwise(3)
    rows = entries.withColumn("part", part).withColumn("no", F.row_number().over(Window.partitionBy("source", "part").orderBy("page_idx", "ord")))
    line = F.concat(F.col("part").cast("string"), F.lit("."), F.col("no").cast("string"), F.lit(" "), bare_title(F.col("title")), F.lit("  → page "), (F.col("page_idx") + 1).cast("string"))
    g = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("part", "no", line.alias("l")))).alias("x"))
    head = F.array(
        F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Author: "), "author"), F.concat(F.lit("Primary Language: "), "language"),
        F.concat(F.lit("Language breakdown: "), "breakdown"), F.concat(F.lit("Images extracted: "), F.col("images").cast("string")), F.lit("Table of Contents:"),
    )
    none = F.array().cast("array<string>")
    lines = F.concat(head, F.coalesce(F.transform("x", lambda s: s["l"]), none))
    return books.join(g, "source", "left").select("source", F.concat(strip(F.array_join(lines, "\n")), F.lit("\n")).alias("report"))


def voice_notes(name: Column, clips: Column, seconds: Column, quality: Column, origin: Column) -> Column:
    """A voice's notes in Markdown: files, use, statistics and where its samples come from; in words of our own."""
    return F.concat(
        F.lit("# Voice Model: "), name, F.lit("\n\n## Files\n- `voice_profile.json`: characteristics\n- `voice_samples/`: "), clips.cast("string"),
        F.lit(" sample clips\n\n## Statistics\n- Total samples: "), clips.cast("string"), F.lit("\n- Total duration: "), seconds.cast("string"),
        F.lit("s\n- Quality score: "), F.format_string("%.2f", quality), F.lit("\n\n## Source\n"), F.coalesce(origin, F.lit("unknown")), F.lit("\n"),
    )


def preset_of(asked: DataFrame, presets: DataFrame, default: str) -> DataFrame:
    """`asked` (with a column `style`) with its preset's values; unknown styles get the default's. The presets are few and
    joined by name."""
    known = presets.select(F.col("style").alias("known"))
    named = asked.join(known, F.col("style") == F.col("known"), "left").withColumn("known", F.coalesce("known", F.lit(default)))
    return named.join(presets.withColumnRenamed("style", "known"), "known").drop("known")
