"""Language profiles from marker words, a parameter; no detector model is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import words


def marker_shares(docs: DataFrame, markers: list[tuple[str, list[str]]] = P.LANG_MARKERS) -> DataFrame:
    """(doc_id, total, lang, hits, share): of a text's words, stripped of punctuation, those that mark each language."""
    w = F.transform(words(F.lower(F.coalesce("text", F.lit("")))), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\p{Punct}+", ""), r"\p{Punct}+$", ""))
    base = docs.select("doc_id", w.alias("w"))
    hits = F.array(*[F.struct(F.lit(lang).alias("lang"), F.size(F.filter("w", _among(ws))).alias("hits")) for lang, ws in markers])
    out = base.select("doc_id", F.size("w").alias("total"), F.explode(hits).alias("h"))
    return out.select("doc_id", "total", "h.lang", "h.hits", F.when(F.col("total") > 0, F.col("h.hits") / F.col("total")).otherwise(0.0).alias("share"))


def _among(ws: list[str]):
    return lambda x: x.isin(ws)


def top_languages(shares: DataFrame, most: int = 5, least: float = 0.005) -> DataFrame:
    """Languages by share, at most `most`, above `least`."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("share"), "lang"))
    return shares.withColumn("rank", k).where((F.col("rank") <= most) & (F.col("share") > least)).select("doc_id", "rank", "lang", "share")


def chunk_languages(docs: DataFrame, size: int = 50, least: int = 50, markers: list[tuple[str, list[str]]] = P.LANG_MARKERS) -> DataFrame:
    """(doc_id, lang, share): of a text's chunks of `size` sentences, those whose most frequent markers are a language's.

    The detector is the greatest count of markers, the first language of equals; chunks without any, and those under
    `least` characters, belong to none but count in the whole.
    """
    parts = F.split(F.coalesce("text", F.lit("")), r"\. ")
    n = F.ceil(F.size(parts) / size).cast("int")
    chunk = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, i * size + 1, F.lit(size)), ". "))
    rows = docs.select("doc_id", n.alias("chunks"), F.explode(chunk).alias("c")).withColumn("w", words(F.lower("c")))
    best = F.array_max(F.array(*[F.struct(F.size(F.filter("w", _among(ws))).alias("hits"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(markers)]))
    rows = rows.withColumn("best", best).where((F.length(F.trim("c")) >= least) & (F.col("best.hits") > 0))
    return rows.groupBy("doc_id", "chunks", F.col("best.lang").alias("lang")).agg(F.count("*").alias("n")).select("doc_id", "lang", (F.col("n") / F.col("chunks")).alias("share"))


def merged_languages(docs: DataFrame, markers: list[tuple[str, list[str]]] = P.LANG_MARKERS) -> DataFrame:
    """Chunk shares plus 0.3 of the marker shares over a thousandth: (doc_id, rank, lang, share), five at most. The language of
    the whole text, `unknown` without any marker, is added at 0.5 if neither has it."""
    shares = marker_shares(docs, markers)
    marks = shares.where("share > 0.001").select("doc_id", "lang", (F.col("share") * 0.3).alias("share"), F.lit(False).alias("whole"))
    order = F.lit(0)
    for i, (lang, _) in enumerate(markers):
        order = F.when(F.col("lang") == lang, -i).otherwise(order)
    best = shares.groupBy("doc_id").agg(F.max(F.struct("hits", order.alias("o"), "lang")).alias("b"))
    primary = best.select("doc_id", F.when(F.col("b.hits") > 0, F.col("b.lang")).otherwise("unknown").alias("lang"), F.lit(0.0).alias("share"), F.lit(True).alias("whole"))
    chunks = chunk_languages(docs, markers=markers).withColumn("whole", F.lit(False))
    both = chunks.unionByName(marks).unionByName(primary).groupBy("doc_id", "lang").agg(F.sum("share").alias("share"), F.every("whole").alias("alone"))
    return top_languages(both.select("doc_id", "lang", F.when(F.col("alone"), 0.5).otherwise(F.col("share")).alias("share")))


def language_report(merged: DataFrame) -> DataFrame:
    """(doc_id, primary, rank, name, percent): display names, of equal names the later; percents to 2 places."""
    names = F.create_map(*[F.lit(x) for kv in P.LANG_NAMES.items() for x in kv])
    named = merged.withColumn("name", F.coalesce(F.get(F.map_values(F.map_filter(names, lambda k, v: k == F.col("lang"))), F.lit(0)), F.initcap("lang")))
    first = F.min_by("name", "rank").over(Window.partitionBy("doc_id"))
    last = F.max("rank").over(Window.partitionBy("doc_id", "name"))
    return named.withColumn("primary", first).withColumn("last", last).where("rank = last").select("doc_id", "primary", "rank", "name", F.round(F.col("share") * 100, 2).alias("percent"))
