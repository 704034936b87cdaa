"""Chunking of texts on sentence ends: greedy folds over the sentences of one text, whose state is the chunk that is being
filled (see `functions.fold`).

Each packer gives an array of chunks; null and empty texts give an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.fold import bind, blocked
from quillspark.functions.text import sentences_any, sentences_capital, sentences_spaces, strip, words

NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(NONE)


def _state(cur: Column, size: Column | None = None) -> Column:
    return F.struct(cur.alias("cur"), *([size.alias("size")] if size is not None else []))


def _next(state: Column, out: Column | None = None) -> Column:
    return F.struct(state.alias("state"), (_empty() if out is None else out).alias("out"))


def _one(x: Column, when: Column) -> Column:
    return F.when(when, F.array(x)).otherwise(_empty())


def _full(x: Column) -> Column:
    return _one(x, x != "")


def _pack(items: Column, step: Callable[[Column, Column], Column], last: Callable[[Column], Column], zero: Column | None = None) -> Column:
    """What the steps give out, and what `last` makes of the state they end with."""
    return bind(blocked(items, _state(F.lit("")) if zero is None else zero, step, "string"), lambda r: F.concat(r["out"], last(r["state"]["cur"])))


def _safe(text: Column, chunks: Column) -> Column:
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", _empty()).otherwise(chunks)


def _joined(cur: Column, s: Column) -> Column:
    return strip(F.concat_ws(" ", cur, s))


def pack_trailing(text: Column, most: int = 4800, least: int = 20) -> Column:
    """Sentences with a trailing space each, up to `most`; pieces below `least` are dropped and a long sentence stays whole."""
    def keep(cur: Column) -> Column:
        return bind(strip(cur), lambda x: _one(x, F.length(x) >= least))

    def step(a: Column, s: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(s) <= most
        return F.when(fits, _next(_state(F.concat(a["cur"], s, F.lit(" "))))).otherwise(_next(_state(F.concat(s, F.lit(" "))), keep(a["cur"])))

    return _safe(text, _pack(sentences_spaces(text), step, keep))


def pack_words(text: Column, most: int) -> Column:
    """Words packed with single spaces up to `most`; a longer word stays whole."""
    def step(a: Column, w: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(w) + 1 <= most
        return F.when(fits, _next(_state(_joined(a["cur"], w)))).otherwise(_next(_state(w), _full(a["cur"])))

    return _pack(words(text), step, _full)


def split_clauses(sentence: Column, most: int) -> Column:
    """Parts of an over-long sentence: the first separator whose packed parts all fit and are several, else words."""
    def attempt(pattern: str, separator: str) -> Column:
        def step(a: Column, p: Column) -> Column:
            over = (a["cur"] != "") & (F.length(a["cur"]) + F.length(p) > most)
            return F.when(over, _next(_state(F.concat(p, F.lit(separator))), F.array(strip(a["cur"])))).otherwise(_next(_state(F.concat(a["cur"], p, F.lit(separator)))))

        def parts(pieces: Column) -> Column:
            rest = F.slice(pieces, 2, F.size(pieces))
            return _pack(rest, step, lambda cur: F.array(strip(F.left(cur, F.length(cur) - len(separator)))), _state(F.concat(F.element_at(pieces, 1), F.lit(separator))))

        whole = bind(F.split(sentence, pattern), lambda x: F.when(F.size(x) > 1, parts(x)))
        return bind(whole, lambda x: F.when((F.size(x) > 1) & F.forall(x, lambda p: F.length(p) <= most), x))

    return F.when(F.length(sentence) <= most, F.array(sentence)).otherwise(F.coalesce(*[attempt(p, s) for p, s in P.CLAUSES], pack_words(sentence, most)))


def pack_clauses(text: Column, most: int = 250, least: int = 50) -> Column:
    """Sentences up to `most`, long ones split at clauses; a small tail joins the chunk before or vanishes."""
    def step(a: Column, s: Column) -> Column:
        n = F.length(s)
        long = _next(_state(F.lit(""), F.lit(0)), F.concat(_full(a["cur"]), F.filter(split_clauses(s, most), lambda p: F.length(p) >= least)))
        fresh = _next(_state(s, n), _full(a["cur"]))
        more = _next(_state(F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s)), a["size"] + n + 1))
        return F.when(n > most, long).when(a["size"] + n + 1 > most, fresh).otherwise(more)

    def finish(out: Column, cur: Column) -> Column:
        n = F.size(out)
        merged = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(out, -1), F.lit(" "), cur)))
        return F.when(cur == "", out).when(F.length(cur) >= least, F.concat(out, F.array(cur))).when(n > 0, merged).otherwise(out)

    packed = blocked(sentences_capital(strip(text)), _state(F.lit(""), F.lit(0)), step, "string")
    return _safe(text, bind(packed, lambda r: finish(r["out"], r["state"]["cur"])))


def _pack_long(text: Column, most: int, pieces: Callable[[Column], Column]) -> Column:
    """Sentences up to `most`; of a long one's pieces all but the last go before what is pending."""
    def step(a: Column, s: Column) -> Column:
        n, cur = F.length(s), a["cur"]
        long = bind(pieces(s), lambda x: _next(_state(F.element_at(x, -1)), F.concat(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), _full(cur))))
        return F.when(n > most, long).when(F.length(cur) + n + 1 <= most, _next(_state(_joined(cur, s)))).otherwise(_next(_state(s), _full(cur)))

    done = _pack(sentences_any(strip(text)), step, _full)
    return _safe(text, F.filter(F.transform(done, strip), lambda x: x != ""))


def pack_wrapped(text: Column, most: int = 220) -> Column:
    """Sentences up to `most`; a long one is wrapped at words, its full lines going before what is pending."""
    return _pack_long(text, most, lambda s: pack_words(s, most))


def pack_cut(text: Column, most: int = 200) -> Column:
    """Sentences up to `most`; a long one is cut by characters, its full pieces going before what is pending."""
    def cut(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substring(s, i * most + 1, F.lit(most)))

    return _pack_long(text, most, cut)


def pack_paragraphs(text: Column, most: int = 5000, least: int = 30) -> Column:
    """Paragraphs up to `most`, joined by blank lines; a long one is packed by sentences."""
    keep = lambda cur: _one(cur, F.length(cur) >= least)
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")

    def sentence(a: Column, s: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(s) + 1 <= most
        return F.when(fits, _next(_state(F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s))))).otherwise(_next(_state(s), keep(a["cur"])))

    def step(a: Column, p: Column) -> Column:
        joined = _next(_state(F.when(a["cur"] == "", p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p))))
        long = bind(blocked(sentences_any(p), _state(F.lit("")), sentence, "string"), lambda r: _next(r["state"], F.concat(keep(a["cur"]), r["out"])))
        return F.when(F.length(a["cur"]) + F.length(p) + 2 <= most, joined).when(F.length(p) > most, long).otherwise(_next(_state(p), keep(a["cur"])))

    return _safe(text, _pack(paragraphs, step, keep))


def chunk_check(text: Column, chunks: Column, least: int = 20) -> Column:
    """(ok, missing words, tiny chunks)."""
    missing = F.size(words(text)) - F.size(words(F.array_join(chunks, " ")))
    tiny = F.size(F.filter(chunks, lambda c: F.length(c) < least))
    return F.struct(((missing == 0) & (tiny == 0)).alias("ok"), missing.alias("missing"), tiny.alias("tiny"))
