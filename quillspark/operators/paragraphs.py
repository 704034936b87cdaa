"""Paragraphs rebuilt across line and page breaks, as Column expressions over the lines of one text.

Whether a line goes on with the paragraph before it depends on that paragraph only by its open quotes and brackets and how it
ends. So a fold carries these few values along the lines and marks where paragraphs start; texts are put together from the
marks. A second fold joins a paragraph that does not end with a sentence to one that starts in lower case, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.fold import bind, blocked
from quillspark.functions.text import collapse, lines, n_words, strip

OPENER = "^(?:" + "|".join(P.OPENERS) + ")"
CONTINUATION = "(?i)^(?:" + "|".join(P.CONTINUATIONS) + ")"
LOWER, UPPER = r"^\p{IsLowercase}", r"^\p{IsUppercase}"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _traits(t: Column, gap: Column) -> Column:
    """What the fold needs to know of a line, and whether a blank one or none stands before it."""
    n, upper = n_words(t), t.rlike(UPPER)
    capitals = (F.upper(t) == t) & t.rlike(r"\p{IsUppercase}")
    return F.struct(
        gap.alias("gap"), (upper & (n <= 3)).alias("title"), t.rlike(CONTINUATION).alias("joins"), (t.rlike(OPENER) | capitals | (upper & (n > 8))).alias("opens"), t.rlike(LOWER).alias("lower"),
        (_count(t, '"') % 2 == 1).alias("quote"), (_count(t, "'") % 2 == 1).alias("apostrophe"), (_count(t, "(") - _count(t, ")")).alias("brackets"), t.rlike(P.UNFINISHED).alias("unfinished"),
    )


def _starts(traits: Column) -> Column:
    """For each line whether a paragraph starts with it."""
    state = ["quote", "apostrophe", "brackets", "unfinished"]
    of = lambda q, a, b, u: F.struct(*[c.alias(name) for name, c in zip(state, (q, a, b, u))])

    def step(a: Column, x: Column) -> Column:
        pending = (a["unfinished"] | a["apostrophe"] | x["lower"]) & ~x["opens"]
        goes_on = ~x["gap"] & ~x["title"] & (a["quote"] | (a["brackets"] > 0) | x["joins"] | pending)
        more = of(a["quote"] != x["quote"], a["apostrophe"] != x["apostrophe"], a["brackets"] + x["brackets"], x["unfinished"])
        fresh = of(x["quote"], x["apostrophe"], x["brackets"], x["unfinished"])
        return bind(goes_on, lambda g: F.struct(F.when(g, more).otherwise(fresh).alias("state"), F.array(~g).alias("out")))

    return blocked(traits, of(F.lit(False), F.lit(False), F.lit(0), F.lit(False)), step, "boolean")["out"]


def _paragraphs(kept: Column, starts: Column) -> Column:
    """(t, gap) of each paragraph: its lines with single spaces, a line alone as it is."""
    at = F.filter(F.sequence(F.lit(1), F.size(starts)), lambda i: F.element_at(starts, i))

    def text(i: Column, to: Column) -> Column:
        part = F.transform(F.slice(kept, i, to - i), lambda x: x["t"])
        return F.struct(F.when(to - i == 1, F.element_at(part, 1)).otherwise(collapse(F.array_join(part, " "))).alias("t"), F.element_at(kept, i)["gap"].alias("gap"))

    return bind(at, lambda at: F.transform(at, lambda i, k: text(i, F.coalesce(F.get(at, k + 1), F.size(kept) + 1))))


def _joined(paragraphs: Column) -> Column:
    """Paragraphs as one text; of neighbours that belong together each second one is joined to the one before."""
    section = "^(?:" + "|".join(P.SECTION_WORDS) + ")"
    fits = F.transform(paragraphs, lambda x, i: F.coalesce((i > 0) & ~F.get(paragraphs, i - 1)["t"].rlike("[.!?]$") & x["t"].rlike(LOWER) & ~x["t"].rlike(section), F.lit(False)))
    # a paragraph that was joined to the one before takes none itself
    marks = blocked(fits, F.lit(False), lambda a, x: bind(x & ~a, lambda j: F.struct(j.alias("state"), F.array(j).alias("out"))), "boolean")["out"]
    parts = bind(marks, lambda m: F.transform(paragraphs, lambda x, i: F.concat(F.when(i == 0, "").when(F.get(m, i), " ").when(x["gap"], "\n\n").otherwise("\n"), x["t"])))
    return strip(F.regexp_replace(F.array_join(parts, ""), " {2,}", " "))


def rebuilt(text: Column) -> Column:
    """A text with its paragraphs rebuilt; null and blank texts are empty."""
    def over(ls: Column) -> Column:
        rows = F.transform(ls, lambda t, i: F.struct(t.alias("t"), F.coalesce((i == 0) | (F.get(ls, i - 1) == ""), F.lit(True)).alias("gap")))
        kept = F.filter(rows, lambda x: x["t"] != "")
        return bind(kept, lambda k: F.when(F.size(k) == 0, "").otherwise(bind(_starts(F.transform(k, lambda x: _traits(x["t"], x["gap"]))), lambda s: bind(_paragraphs(k, s), _joined))))

    return bind(F.transform(lines(F.coalesce(text, F.lit(""))), strip), over)


def rebuild_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with paragraphs rebuilt."""
    return docs.select("doc_id", rebuilt(F.col("text")).alias("text"))
