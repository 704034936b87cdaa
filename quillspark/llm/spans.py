"""Spans within one text, (start, end) with exclusive ends, in time linear in their number but for sorting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.fold import bind, blocked


def placed(found: Column, gaps: Column, size: Callable[[Column], Column], span: Callable[[Column, Column, Column, Column, Column], Column], emits: str) -> Column:
    """What `span(start, end, match, gap before, gap behind)` makes of each match, of the matches and the pieces between them;
    `size` is how far a piece or match reaches."""
    def of(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).alias("behind")))

        def step(at: Column, s: Column) -> Column:
            start = at + size(s["gap"])
            return bind(F.struct(start.alias("start"), (start + size(s["m"])).alias("end")), lambda x: F.struct(x["end"].alias("state"), F.array(span(x["start"], x["end"], s["m"], s["gap"], s["behind"])).alias("out")))

        return blocked(steps, F.lit(0), step, emits)["out"]

    none = F.array().cast(f"array<{emits}>")
    return bind(found, lambda f: F.when(F.size(f) == 0, none).otherwise(bind(gaps, lambda g: of(f, g))))  # most texts hold no match


def along(xs: Column, zero: int, value: Callable[[Column, Column], Column]) -> Column:
    """Running values over spans: what `value` makes of the one before and a span."""
    return blocked(xs, F.lit(zero), lambda a, x: bind(value(a, x), lambda v: F.struct(v.alias("state"), F.array(v).alias("out"))), "int")["out"]


def clusters(spans: Column, nested: bool = False) -> Column:
    """Spans in arrays, such that spans of different ones don't overlap, or with `nested` don't lie within each other.

    They must be sorted by start, with `nested` then by falling end. A new array begins where no span before reaches; with
    `nested` where no span from here on ends by the farthest end before.
    """
    def of(xs: Column) -> Column:
        reach = along(xs, 0, lambda a, x: F.greatest(a, x["end"]))
        least = F.reverse(along(F.reverse(xs), 2**31 - 1, lambda a, x: F.least(a, x["end"])))
        bounds = bind(F.struct(reach.alias("r"), (least if nested else F.transform(xs, lambda x: x["start"] + 1)).alias("l")), lambda b: F.filter(F.sequence(F.lit(1), F.size(xs)), lambda i: (i == 1) | (F.get(b["l"], i - 1) > F.get(b["r"], i - 2))))
        return bind(bounds, lambda at: F.transform(at, lambda i, k: F.slice(xs, i, F.coalesce(F.get(at, k + 1), F.size(xs) + 1) - i)))

    return bind(spans, lambda xs: F.when(F.size(xs) == 0, F.filter(F.array(xs), lambda x: F.lit(False))).otherwise(of(xs)))


def best_first(spans: Column, rank: Callable[[Column], Column], clash: Callable[[Column, Column], Column], nested: bool = False) -> Column:
    """The spans, in order of rank (a struct, least first), that clash with none kept before them. Only spans that overlap may
    clash, with `nested` only those within each other; they are sorted as `clusters` wants them, and compared within one."""
    def chosen(xs: Column) -> Column:
        ordered = F.array_sort(F.transform(xs, lambda x: F.struct(rank(x).alias("r"), x.alias("x"))))
        none = F.filter(xs, lambda x: F.lit(False))
        return F.aggregate(ordered, none, lambda out, o: F.when(F.exists(out, lambda k: clash(k, o["x"])), out).otherwise(F.concat(out, F.array(o["x"]))))

    return F.flatten(F.transform(clusters(spans, nested), lambda xs: F.when(F.size(xs) == 1, xs).otherwise(chosen(xs))))


def apart_from(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others, both sorted by start: one sweep from either side, with the farthest end and the
    next start of the others."""
    event = lambda x, other: F.struct(x["start"].alias("start"), F.lit(0 if other else 1).alias("o"), x["end"].alias("end"))

    def of(xs: Column) -> Column:
        both = F.array_sort(F.concat(F.transform(others, lambda x: event(x, True)), F.transform(xs, lambda x: event(x, False))))

        def sweep(events: Column, zero: Column, state: Callable[[Column, Column], Column], free: Callable[[Column, Column], Column]) -> Column:
            none = F.array().cast("array<boolean>")
            return blocked(events, zero, lambda a, e: F.struct(F.when(e["o"] == 0, state(a, e)).otherwise(a).alias("state"), F.when(e["o"] == 1, F.array(free(a, e))).otherwise(none).alias("out")), "boolean")["out"]

        def flags(es: Column) -> Column:
            ahead = sweep(es, F.lit(0), lambda a, e: F.greatest(a, e["end"]), lambda a, e: e["start"] >= a)
            behind = F.reverse(sweep(F.reverse(es), F.lit(2**31 - 1), lambda a, e: e["start"], lambda a, e: e["end"] <= a))
            return F.struct(ahead.alias("a"), behind.alias("b"))

        return bind(bind(both, flags), lambda f: F.filter(xs, lambda x, i: F.get(f["a"], i) & F.get(f["b"], i)))

    return bind(spans, lambda xs: F.when((F.size(xs) == 0) | (F.size(others) == 0), xs).otherwise(of(xs)))
