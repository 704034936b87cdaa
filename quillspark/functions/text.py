"""Text functions as Column expressions. The regular expressions in them are fixed values that results depend on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; two anchored passes."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def sentences_spaces(c: Column) -> Column:
    """After . ? ! at spaces."""
    return F.split(c, r"(?<=[.?!]) +")


def sentences_any(c: Column) -> Column:
    """After . ! ? at white space of any kind."""
    return F.split(c, r"(?<=[.!?])\s+")


def sentences_capital(c: Column) -> Column:
    """At white space between a terminator (and quote) and a capital; in one piece, as `sentences_any`."""
    s = F.split(c, r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?][\"'])\s+(?=[A-Z])")
    return F.filter(F.transform(F.when(F.size(s) == 1, sentences_any(c)).otherwise(s), strip), lambda x: x != "")


def replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def spoken(c: Column, degrees: bool = True) -> Column:
    """Spoken form: letters, degrees, titles, units, years, thousands and initials, in this order."""
    steps = [*P.SPELT, *(P.DEGREES if degrees else []), *P.TITLES, *P.UNITS, *P.NUMBERS]
    return collapse(replace_all(c, steps))


def prepare(c: Column, remove_quotes: bool = False) -> Column:
    """Plain punctuation, ASCII or letters, single spaces."""
    x = F.translate(c, "“”‘’ \t\n\r", "\"\"''    ")
    x = F.replace(F.replace(F.replace(x, F.lit("—"), F.lit(" - ")), F.lit("–"), F.lit(" - ")), F.lit("…"), F.lit("..."))
    x = F.translate(x, "\"'", "") if remove_quotes else x
    return collapse(F.regexp_replace(x, r"[^\x00-\x7F\p{L}]", " "))


def roman(c: Column) -> Column:
    """Value of a roman numeral; null for other texts and for a total of 0."""
    value = F.create_map(*[F.lit(x) for k, v in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)) for x in (k, v)])
    low = F.lower(c)
    total = F.aggregate(
        F.reverse(F.split(low, "")), F.struct(F.lit(0).alias("t"), F.lit(0).alias("p")),
        lambda a, x: F.struct((a["t"] + F.when(value[x] < a["p"], -value[x]).otherwise(value[x])).alias("t"), value[x].alias("p")),
        lambda a: a["t"],
    )
    return F.when(low.rlike("^[ivxlcdm]+$"), F.when(total > 0, total))


def toc_line(c: Column) -> Column:
    """(title, page) of a contents line, null if it has no leader."""
    rx = r"^\s*(.+?)[.\-\s]{2,}(\S+)\s*$"
    x = F.translate(c, "–—‒", "---")
    title = F.regexp_replace(strip(F.regexp_extract(x, rx, 1)), r"[.\-\s–—_]+$", "")
    return F.when(x.rlike(rx), F.struct(title.alias("title"), F.regexp_extract(x, rx, 2).alias("page")))


def chapter_number(title: Column) -> Column:
    """A leading number such as 33 or 2.9, else null."""
    return F.nullif(F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)?)", 1), F.lit(""))


def bare_title(title: Column) -> Column:
    return F.regexp_replace(title, r"^\d+[.)]\s*", "")


def footer_label(page_lines: Column) -> Column:
    """The printed label among the last two non-blank lines; the earlier of them has precedence."""
    rx = r"(?i)^(?:page\s*)?([ivxlcdm\d]+)$"
    tail = F.slice(page_lines, F.greatest(F.size(page_lines) - 1, F.lit(1)), 2)
    hit = F.filter(F.transform(tail, lambda x: F.regexp_extract(strip(F.replace(F.lower(x), F.lit("."), F.lit(""))), rx, 1)), lambda x: x != "")
    return F.when(F.size(page_lines) > 0, F.get(hit, F.lit(0)))


def file_name(number: Column, title: Column) -> Column:
    safe = F.substring(F.regexp_replace(F.regexp_replace(strip(title), r"[^a-zA-Z0-9_\-\s]", ""), r"\s+", "_"), 1, 50)
    return F.concat(F.lit("chapter_"), F.lpad(number.cast("string"), 2, "0"), F.lit("_"), safe, F.lit(".txt"))


def voice_slug(name: Column) -> Column:
    return F.concat(F.lit("speaker_"), F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def snippet(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def video_id(url: Column) -> Column:
    tries = [r"(?:youtube\.com/watch\?v=|youtu\.be/)([^&\n?#]+)", r"youtube\.com/embed/([^&\n?#]+)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(url, rx, 1), F.lit("")) for rx in tries])


def keyword_class(c: Column, classes: list[tuple[str, list[str]]], default: str = "neutral") -> Column:
    """The first class one of whose keywords the text contains."""
    out = F.lit(default)
    for name, keywords in reversed(classes):
        out = F.when(reduce(lambda a, k: a | F.contains(F.lower(c), F.lit(k)), keywords, F.lit(False)), name).otherwise(out)
    return out


def contains_any(c: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, k: a | F.contains(c, F.lit(k)), keywords, F.lit(False))


def duration_estimate(n_chars: Column, rate: float = 0.08, most: float = 1e9) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(most), n_chars * F.lit(rate)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def middle_capitals(chunks: Column) -> Column:
    """Chunks but the first and last start with a capital."""
    return F.transform(chunks, lambda x, i: F.when((i > 0) & (i < F.size(chunks) - 1), F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))).otherwise(x))


def title_case(c: Column) -> Column:
    """Each run of letters that have a case with a capital first and small ones after, as in O'Neil-Smith; `initcap` only knows
    spaces. Letters whose capital is two letters get both as capitals."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")
