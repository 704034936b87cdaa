"""License scans by ordered signature rules.

`license_rules.RULES` are hand-written expressions over a text's normalised words: identifiers, wording of licenses,
notices, grants, names and mentions. Keywords are a prefilter: a rule runs only on texts that hold one of its keywords as a word, and a
match can't do without one. Detections are intervals of words. Where one lies inside another, the higher priority stays,
then the longer, the earlier and the first label; detections that overlap otherwise stay both.

Defined results: null and empty texts have no words, no places and score 0. Rows are handled one by one, so repeated
rows and ids give repeated results, and extra columns don't matter; an empty table gives an empty result. Texts of any
length are read whole. Equal intervals and priorities are decided by the label's order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import NON_WORD, ascii_lower, table
from quillspark.llm.license_rules import RULES
from quillspark.llm.spans import best_first, placed

# Fixed values of the contract: phrase and label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
Rule = tuple[str, str, tuple[str, ...], int, float]
SPAN = "array<struct<start:int,end:int,priority:int,sure:double,label:string>>"
PLACE = "array<struct<start:int,label:string>>"


def strings(xs: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(xs)), "array<string>")


def rules_array(rules: list[Rule]) -> Column:
    """The rules as one constant."""
    rows = [{"label": a, "rx": b, "keywords": list(c), "priority": d, "sure": e} for a, b, c, d, e in rules]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,rx:string,keywords:array<string>,priority:int,sure:double>>")


def spans_of(norm: Column, rule: Column) -> Column:
    """Word intervals [start, end) of a rule's matches in ' w0 w1 ... '; a match begins at the space before a word."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    def span(start: Column, end: Column, m: Column, gap: Column, behind: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["sure"].alias("sure"), rule["label"].alias("label"))

    return placed(F.regexp_extract_all(norm, rule["rx"], F.lit(0)), F.split(norm, rule["rx"]), spaces, span, SPAN[6:-1])


def suppress(spans: Column) -> Column:
    """Without the intervals that lie inside, or hold, one that goes before: by priority, length, place and label."""
    nested = lambda a, b: ((a["start"] >= b["start"]) & (a["end"] <= b["end"])) | ((b["start"] >= a["start"]) & (b["end"] <= a["end"]))
    rank = lambda s: F.struct((-s["priority"]).alias("p"), (s["start"] - s["end"]).alias("n"), s["start"].alias("s"), s["label"].alias("l"))
    outer_first = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["priority"].alias("priority"), s["sure"].alias("sure"), s["label"].alias("label"))))
    ordered = F.transform(outer_first, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["priority"].alias("priority"), s["sure"].alias("sure"), s["label"].alias("label")))
    return F.array_sort(best_first(ordered, rank, nested, True))


def scan(docs: DataFrame, rules: list[Rule] = RULES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, places (start, label of each base phrase), detections (start, end, priority,
    sure, label)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), NON_WORD, " ")), F.lit(" "))
    words = F.split("norm", " ")  # with an empty one at either end
    keywords = sorted({k for r in rules for k in r[2]} | {p.split(" ")[-1] for p, _ in phrases})
    base = docs.select("doc_id", norm.alias("norm")).withColumn("words", words)
    base = base.select("doc_id", "norm", F.size(F.filter("words", lambda w: w != "")).cast("long").alias("n_words"), F.arrays_overlap("words", strings(keywords)).alias("any"), "words")
    base = base.select("doc_id", "n_words", "norm", F.when(F.col("any"), F.array_intersect(strings(keywords), F.col("words"))).alias("found"))
    place = lambda p, label: F.transform(
        spans_of(F.col("norm"), F.struct(F.lit(f" {p}(?= )").alias("rx"), F.lit(9).alias("priority"), F.lit(0.9).alias("sure"), F.lit(label).alias("label"))),
        lambda s: F.struct(s["start"].alias("start"), s["label"].alias("label")),
    )
    places = F.flatten(F.array(*[F.when(F.array_contains("found", p.split(" ")[-1]), place(p, label)).otherwise(F.array().cast(PLACE)) for p, label in phrases])) if phrases else F.array().cast(PLACE)
    live = F.filter(rules_array(rules), lambda r: F.arrays_overlap(r["keywords"], F.col("found"))) if rules else None
    detections = suppress(F.flatten(F.transform(live, lambda r: spans_of(F.col("norm"), r)))) if rules else F.array().cast(SPAN)
    return base.select(
        "doc_id", "n_words",
        F.when(F.col("found").isNotNull(), places).otherwise(F.array().cast(PLACE)).alias("places"),
        F.when(F.col("found").isNotNull(), detections).otherwise(F.array().cast(SPAN)).alias("detections"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lambda x: F.transform(x, lambda p: p["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels("places")).alias("base_labels"), joined(F.concat(labels("places"), labels("detections"))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0)), F.when(F.size("places") > 0, 0.9).otherwise(0.0)).alias("score"),
    )


def op8_license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can state."""
    return op8_license_scan(spark, sf_dir).drop("labels", "score")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS at_, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
        WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label
  FROM w, unnest(range(1, len(w))) AS t(i) WHERE w[i] IN ('mit', 'apache', 'general')),
g AS (SELECT doc_id, count(*) AS n_base, min(at_) AS first_word, max(at_) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p WHERE label IS NOT NULL GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
