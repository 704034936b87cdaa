"""Contents entries, sections, chapter ranges and page lookups.

Entries are (source, ord, title, page_idx[, printed]); every ordered step takes its order from `ord`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import chapter_number, footer_label, roman, strip, toc_line
from quillspark.functions.text import lines as lines_of
from quillspark.operators.lines import is_rear_matter
from quillspark.operators.order import least_from
from quillspark.sources.io import stored


def unite(bookmarks: DataFrame, texts: DataFrame) -> DataFrame:
    """Union by (lower title, page): the place of a key's first entry, the value of its last bookmark, else of its first text entry."""
    both = bookmarks.withColumn("rank", F.lit(0)).unionByName(texts.withColumn("rank", F.lit(1))).withColumn("low", F.lower("title"))
    order = F.struct("rank", "ord")
    value = F.struct("title", "ord")
    g = both.groupBy("source", "low", "page_idx").agg(
        F.min(order).alias("first"), F.max_by(value, F.when(F.col("rank") == 0, F.col("ord"))).alias("mark"), F.min_by(value, F.when(F.col("rank") == 1, F.col("ord"))).alias("entry"),
    )
    return g.select("source", F.coalesce("mark.title", "entry.title").alias("title"), "page_idx", F.col("first.rank").alias("origin"), F.col("first.ord").alias("ord"))


def deduplicate(entries: DataFrame) -> DataFrame:
    """Entries whose title and number no kept entry before them has; then the first per page.

    A number is read off its title, so titles that are alike have one number: entries fall into groups by number, or by title
    where there is none, and within a group each excludes all others. What is kept is thus the first of each group, which
    needs no fold over a source. Null titles are alike; of equal places the least title and page come first.
    """
    title = strip(F.col("title"))
    key = F.coalesce(F.concat(F.lit("n"), chapter_number(title)), F.concat(F.lit("t"), F.lower(title)))
    rest = [c for c in entries.columns if c not in ("source", "ord", "title", "page_idx")]
    row = F.struct("ord", "title", "page_idx", *rest)
    kept = entries.groupBy("source", key.alias("key_")).agg(F.min(row).alias("e")).select("source", "e.*")
    return kept.groupBy("source", "page_idx").agg(F.min(row).alias("e")).select("source", *[F.col(f"e.{c}").alias(c) for c in ("ord", "title", "page_idx", *rest)])


def sections(entries: DataFrame) -> DataFrame:
    """Adds `section`: front before the first chapter 1 in page order, then rear by keyword, else main."""
    rows = entries.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("page_idx", "ord")))
    one = F.min(F.when(F.lower("title").rlike(r"^(?:chapter\s*)?1[.\s:-]"), F.col("place"))).over(Window.partitionBy("source"))
    rows = rows.withColumn("one", one)
    section = F.when(F.col("place") < F.col("one"), "front").when(is_rear_matter(F.col("title")), "rear").otherwise("main")
    return rows.withColumn("section", section).drop("place", "one")


def chapter_ranges(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Main entries with [start_page, end_page): the next chapter's start, the last to the first rear page or the page count."""
    totals = pages.groupBy("source").agg(F.count("*").alias("n_pages"))
    rear = F.min(F.when(F.col("section") == "rear", F.col("page_idx"))).over(Window.partitionBy("source"))
    marked = sections(entries).withColumn("rear_page", rear).where("section = 'main'").join(totals, "source")
    nxt = F.lead("page_idx").over(Window.partitionBy("source").orderBy("page_idx", "ord"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("page_idx", "ord"))
    end = F.coalesce(nxt, "rear_page", "n_pages")
    return marked.select("source", number.alias("chapter_no"), "title", F.col("page_idx").alias("start_page"), end.cast("int").alias("end_page"))


def chapter_pages(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each chapter: a range becomes its page numbers, so that the join is an equality on (source, page)."""
    numbers = ranges.where("start_page < end_page").withColumn("page_idx", F.explode(F.expr("sequence(start_page, end_page - 1)")))
    return numbers.join(pages, ["source", "page_idx"])


def missing_chapters(entries: DataFrame) -> DataFrame:
    """Numbers in [least, greatest) of a source that no title starts with."""
    numbered = entries.select("source", F.regexp_extract("title", r"^\s*(\d+)", 1).alias("n")).where("n <> ''").groupBy("source").agg(F.collect_set(F.col("n").cast("int")).alias("have"))
    every = F.filter(F.sequence(F.array_min("have"), F.array_max("have")), lambda x: x < F.array_max(F.col("have")))
    return numbered.select("source", F.explode(F.array_except(every, "have")).alias("missing"))


def first_labels(labels: DataFrame) -> DataFrame:
    """(source, label, page_idx, ord): of a printed label that several pages bear, the first counts."""
    g = labels.groupBy("source", F.lower("label").alias("label")).agg(F.min_by(F.struct("page_idx", "ord"), F.struct("ord", "page_idx")).alias("f"))
    return g.select("source", "label", "f.page_idx", "f.ord")


def bookmark_entries(bookmarks: DataFrame) -> DataFrame:
    """Entries (source, ord, title, page_idx) of an outline (source, ord, level, title, page), whose pages count from 1."""
    return bookmarks.select("source", "ord", F.trim("title").alias("title"), (F.col("page") - 1).cast("int").alias("page_idx"))


def section_pages(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, section, page_idx): the pages of front, main and rear matter, which may overlap.

    Front matter reaches to the page of its last entry; main matter from its first entry to the first page of its last;
    rear matter from its first entry, or else the page after main matter's last entry, to the end.
    """
    of = lambda s: F.when(F.col("section") == s, F.col("page_idx"))
    s = sections(entries).groupBy("source").agg(F.max(of("front")).alias("front"), F.min(of("main")).alias("main"), F.max(of("main")).alias("last"), F.min(of("rear")).alias("rear"))
    s = s.join(pages.groupBy("source").agg(F.count("*").cast("int").alias("n_pages")), "source")
    none = F.array().cast("array<struct<section:string,start:int,end:int>>")
    span = lambda name, a, b: F.when(a < b, F.array(F.struct(F.lit(name).alias("section"), a.cast("int").alias("start"), b.cast("int").alias("end")))).otherwise(none)
    first = F.coalesce("rear", F.col("last") + 1, F.lit(0))
    cap = lambda c: F.least(c, F.col("n_pages"))
    ranges = F.concat(span("front", F.lit(0), cap(F.col("front") + 1)), span("main", F.col("main"), cap(F.col("last") + 1)), span("rear", first, F.col("n_pages")))
    out = s.select("source", F.explode(ranges).alias("r")).select("source", "r.section", F.explode(F.expr("sequence(r.start, r.end - 1)")).alias("page_idx"))
    return out


def whole_number(text: Column) -> Column:
    """The value of decimal digits, null for other texts and beyond 38 digits."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("decimal(38,0)"))


def look_up_pages(labels: DataFrame, queries: DataFrame, parts: int | None = None) -> DataFrame:
    """Page of a printed label: the label itself, where it occurs first; else the least page among numeric labels from it on;
    else the first label of its roman value. Labels are (source, label, page_idx, ord), queries (source, query)."""
    q = queries.withColumn("low", F.lower("query")).withColumn("n", whole_number(F.col("query"))).withColumn("r", roman(F.col("query")))
    labels = stored(first_labels(labels), "labels")
    exact = labels.select("source", F.col("label").alias("low"), F.col("page_idx").alias("exact"))
    numeric = labels.select("source", whole_number(F.col("label")).alias("k"), F.col("page_idx").alias("above")).where("k IS NOT NULL")
    asked = q.where("n IS NOT NULL").select("source", F.col("n").alias("k"), "query").distinct()
    above = least_from(numeric, asked, "source", "k", "above", parts).select("source", "query", "above")
    value = F.coalesce(whole_number(F.col("label")), roman(F.col("label")).cast("decimal(38,0)"))
    by_value = labels.withColumn("v", value).where("v IS NOT NULL").groupBy(F.col("source").alias("v_source"), "v").agg(F.min_by("page_idx", "ord").alias("by_value"))
    out = q.join(exact, ["source", "low"], "left").join(above, ["source", "query"], "left")
    out = out.join(by_value, (F.col("source") == F.col("v_source")) & (F.col("r") == F.col("v")), "left")
    return out.select("source", "query", F.coalesce("exact", "above", "by_value").alias("page_idx"))


def _foot(text: Column) -> Column:
    """The label at the foot of a page's text."""
    tail = F.substring_index(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s*\n\s*", "\n")), "\n", -2)
    return footer_label(F.filter(F.split(tail, "\n"), lambda x: x != ""))


def page_labels(pages: DataFrame) -> DataFrame:
    """(source, label, page_idx, ord) of the labels printed at the foot of pages (source, page_idx, text)."""
    return pages.select("source", _foot(F.col("text")).alias("label"), "page_idx", F.col("page_idx").alias("ord")).where("label IS NOT NULL")


def scan_contents(pages: DataFrame, labels: DataFrame | None = None, after: int = 50) -> DataFrame:
    """(source, ord, title, page_idx, printed, found_on): contents lines of pages (source, page_idx, text), each title and page
    once, where it stands first, up to the first page beyond index `after` that adds none.

    Whether a page adds an entry depends on earlier pages only, so first places are found over all pages, pages without one are
    the pages less those places, and the least of them beyond `after` cuts each book: no book is read in one task. Titles
    ascend by `ord` as they stand; a printed page that no label leads to makes no entry. `labels` as in `look_up_pages`, by
    default those at the feet of the pages. Null texts are pages without lines; books that never stop keep all.
    """
    every = F.transform(lines_of(F.coalesce("text", F.lit(""))), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    found = F.filter(every, lambda x: x["line"].rlike(r"(?U)[.\-–—‒\s]{2}[ivxlcdmIVXLCDM0-9]+\s*$"))  # cheap, and true of every line that counts
    # texts are read once: what counts on a page is stored, a few lines and the label at its foot
    pages = stored(pages.select("source", "page_idx", found.alias("found"), _foot(F.col("text")).alias("label")), "contents")
    labels = pages.select("source", "label", "page_idx", F.col("page_idx").alias("ord")).where("label IS NOT NULL") if labels is None else labels
    rows = pages.select("source", F.col("page_idx").alias("found_on"), F.explode("found").alias("l")).select("source", "found_on", "l.*")
    rows = rows.select("source", "found_on", "line_no", toc_line(strip(F.col("line"))).alias("t")).where(F.col("t.page").rlike("^[ivxlcdmIVXLCDM0-9]+$"))
    rows = rows.select("source", "found_on", "line_no", F.col("t.title").alias("title"), F.col("t.page").alias("query"))
    led = look_up_pages(labels, rows.select("source", "query").distinct()).where("page_idx IS NOT NULL")
    at = F.struct("found_on", "line_no", "query")
    first = rows.join(led, ["source", "query"]).groupBy("source", "title", "page_idx").agg(F.min(at).alias("f"))
    first = first.select("source", (F.shiftleft(F.col("f.found_on").cast("long"), 32) + F.col("f.line_no")).alias("ord"), "title", "page_idx", F.col("f.query").alias("printed"), F.col("f.found_on").alias("found_on"))
    adding = first.select("source", F.col("found_on").alias("page_idx")).distinct()
    idle = pages.select("source", "page_idx").where(F.col("page_idx") > after).join(adding, ["source", "page_idx"], "left_anti")
    stops = idle.groupBy("source").agg(F.min("page_idx").alias("stop"))
    return first.join(stops, "source", "left").where(F.col("stop").isNull() | (F.col("found_on") <= F.col("stop"))).drop("stop")
