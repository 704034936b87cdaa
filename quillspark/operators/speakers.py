"""Speakers of scripts and prose: detection by line patterns, counts, traits, merging over chapters, and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import n_words, snippet, strip

NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"


def line_patterns(verbs: list[str]) -> list[tuple[str, int, int]]:
    """(expression, group of the name, group of the words). Fixed values."""
    v = "(?:" + "|".join(verbs) + ")"
    return [
        (rf'"([^"]+)"\s*,?\s*{v}\s+({NAME})', 2, 1), (rf'({NAME})\s+{v}\s*,?\s*"([^"]+)"', 1, 2),
        (r"^([A-Z][A-Z\s]+):\s*(.+)$", 1, 2), (rf"^({NAME}):\s*(.+)$", 1, 2),
    ]


def valid_name(name: Column) -> Column:
    digits = F.regexp_count(name, F.lit(r"\d"))
    return F.length(name).between(2, 50) & ~F.lower(name).isin(P.NOT_SPEAKERS) & name.rlike(r"\p{L}") & (digits <= F.length(name) * 0.5) & (n_words(name) <= 3)


def utterances(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_no, k, speaker, words): every match of every pattern; a line can count more than once."""
    line = strip(F.col("line"))
    found = []
    for i, (rx, who, what) in enumerate(line_patterns(P.ATTRIBUTION_VERBS)):
        names, texts = F.regexp_extract_all(line, F.lit(rx), F.lit(who)), F.regexp_extract_all(line, F.lit(rx), F.lit(what))
        found.append(F.transform(F.arrays_zip(names.alias("a"), texts.alias("b")), lambda x, j: F.struct((F.lit(i).cast("long") * (1 << 32) + j).alias("k"), strip(x["a"]).alias("speaker"), strip(x["b"]).alias("words"))))
    hits = rows.where(F.col("line").rlike('[":]')).select(id_col, "line_no", F.explode(F.concat(*found)).alias("h"))
    return hits.select(id_col, "line_no", "h.*").where(valid_name(F.col("speaker")))


def speaker_counts(found: DataFrame, id_col: str = "doc_id", least: int = 2) -> DataFrame:
    """(id, speaker, dialogues, n_words, ord) of the speakers with at least `least` utterances."""
    g = found.groupBy(id_col, "speaker").agg(F.count("*").alias("dialogues"), F.sum(n_words(F.col("words"))).alias("n_words"), F.min(F.struct("line_no", "k")).alias("first"))
    return g.where(F.col("dialogues") >= least)


def traits(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Formality, excitement, calmness and mean sentence length of each speaker, with the counts they come from."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "k", "words")))
    g = found.groupBy(id_col, "speaker").agg(ordered.alias("x")).withColumn("t", F.array_join(F.transform("x", lambda s: s["words"]), " "))
    count = lambda words: F.regexp_count("t", F.lit(r"(?i)\b(?:" + "|".join(words) + r")\b"))
    formal, casual = count(P.FORMAL), count(P.CASUAL)
    excited = F.regexp_count("t", F.lit(r"(?i)[!]+|[?!]+|\b(?:" + "|".join(P.EXCITED) + r")\b"))
    pieces = F.split("t", "[.!?]+")
    n = F.greatest(F.size(pieces), F.lit(1))
    total = F.aggregate(pieces, F.lit(0), lambda a, s: a + n_words(s))
    return g.select(
        id_col, "speaker", (formal / F.greatest(formal + casual, F.lit(1))).alias("formality"), (excited / n).alias("excitement"),
        (count(P.CALM) / n).alias("calmness"), (total / n).alias("sentence_words"), F.slice(F.transform("x", lambda s: s["words"]), 1, 3).alias("snippets"),
    )


def merge_traits(counts: DataFrame, found: DataFrame, chapter_col: str = "doc_id") -> DataFrame:
    """Over chapters: summed counts, the traits of the first chapter, and the snippets of all in order. `counts`: of the
    speakers that count in a chapter; `found`: their traits."""
    rows = counts.join(found, [chapter_col, "speaker"])
    first = F.min_by(F.struct("formality", "excitement", "calmness", "sentence_words"), chapter_col)
    parts = F.sort_array(F.collect_list(F.struct(chapter_col, "snippets")))
    g = rows.groupBy("speaker").agg(F.sum("dialogues").alias("dialogues"), F.sum("n_words").alias("n_words"), first.alias("t"), parts.alias("x"))
    return g.select("speaker", "dialogues", "n_words", "t.*", F.flatten(F.transform("x", lambda s: s["snippets"])).alias("snippets"))


def merge_speakers(counts: DataFrame, chapter_col: str = "doc_id") -> DataFrame:
    """Over chapters: summed counts, and the first chapter it is seen in."""
    return counts.groupBy("speaker").agg(F.sum("dialogues").alias("dialogues"), F.sum("n_words").alias("n_words"), F.min(chapter_col).alias("first_chapter"), F.count("*").alias("chapters"))


def segments(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seg_no, speaker, text): a line with dialogue is a segment of its own; runs between are the narrator's."""
    line = strip(F.col("line"))
    who, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rx, name, words in reversed(line_patterns(P.SEGMENT_VERBS)):
        hit = line.rlike(rx)
        who = F.when(hit, strip(F.regexp_extract(line, rx, name))).otherwise(who)
        what = F.when(hit, strip(F.regexp_extract(line, rx, words))).otherwise(what)
    r = rows.select(id_col, "line_no", line.alias("line"), who.alias("who"), what.alias("what"))
    r = r.withColumn("spoken", F.coalesce(valid_name(F.col("who")), F.lit(False)))
    # a dialogue line opens an island; after a valid one a new narrator island begins, an invalid one starts its own text
    order = Window.partitionBy(id_col).orderBy("line_no")
    opens = F.col("who").isNotNull().cast("int")
    closes = F.coalesce(F.lag(F.col("spoken").cast("int")).over(order), F.lit(0))
    r = r.withColumn("island", F.sum(opens + closes).over(order))
    g = r.groupBy(id_col, "island", "spoken").agg(F.min("line_no").alias("at"), F.max("who").alias("who"), F.max("what").alias("what"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    joined = strip(F.array_join(F.transform("x", lambda s: s["line"]), "\n"))
    out = g.select(id_col, "at", F.when(F.col("spoken"), F.col("who")).otherwise("narrator").alias("speaker"), F.when(F.col("spoken"), F.col("what")).otherwise(joined).alias("text")).where("text <> ''")
    return out.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("at"))).alias("seg_no"), "speaker", "text")


def round_robin(speakers: DataFrame, voices: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Speaker i of a text gets voice i modulo the number of voices. `voices`: (voice_ord, voice_id)."""
    n = voices.count()
    i = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("dialogues"), "first")) - 1
    return speakers.withColumn("voice_ord", i % n).join(F.broadcast(voices) if n <= 10_000 else voices, "voice_ord")


def foremost(ranked: DataFrame, rank: Column, most: int, id_col: str) -> DataFrame:
    """The first `most` speakers of each text by rank, first place and name; tasks pass on no more than that of a text."""
    k = F.row_number().over(Window.partitionBy(id_col).orderBy(rank, "first", "speaker"))
    return ranked.withColumn("k_", k).where(F.col("k_") <= most).drop("k_")


def greedy_voices(ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One voice per speaker, none twice, in order of dialogues: by the trait over its threshold, else the first unused one.

    `ranked`: traits joined to counts. Each speaker gets a voice while one is left, so only as many as there are voices can: a
    fold over those, since each choice depends on the ones before.
    """
    ranked = foremost(ranked, F.desc("dialogues"), len(P.VOICES), id_col)
    rows = ranked.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct((-F.col("dialogues")).alias("d"), "first", "speaker", "formality", "excitement", "calmness"))).alias("x"))
    catalog = F.array(*[F.struct(F.lit(v).alias("id"), F.array(*[F.lit(t) for t in ts]).alias("traits")) for v, ts in P.VOICES])
    has = lambda v, *ts: F.arrays_overlap(v["traits"], F.array(*[F.lit(t) for t in ts]))

    def step(a, s):
        free = F.filter(catalog, lambda v: ~F.array_contains(a["used"], v["id"]))
        fit = F.filter(free, lambda v: F.when(s["formality"] > 0.7, has(v, "formal", "authoritative")).when(s["excitement"] > 0.5, has(v, "warm")).when(s["calmness"] > 0.5, has(v, "calm", "gentle")).otherwise(False))
        voice = F.coalesce(F.get(fit, F.lit(0))["id"], F.get(free, F.lit(0))["id"])
        return F.when(voice.isNull(), a).otherwise(F.struct(F.concat(a["used"], F.array(voice)).alias("used"), F.concat(a["out"], F.array(F.struct(s["speaker"].alias("speaker"), voice.alias("voice_id")))).alias("out")))

    zero = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<speaker:string,voice_id:string>>").alias("out"))
    return rows.select(id_col, F.explode(F.aggregate("x", zero, step, lambda a: a["out"])).alias("o")).select(id_col, "o.*")


def narrators(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The narrator's row of each text: all its words, one utterance, fixed traits."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(id_col, F.lit("Narrator").alias("speaker"), F.lit(1).cast("long").alias("dialogues"), n_words(text).cast("long").alias("n_words"), F.lit(0.5).alias("formality"), F.lit(0.3).alias("excitement"), F.lit(0.7).alias("calmness"), F.lit(15.0).alias("sentence_words"), snippet(text).alias("snippet"))


def voices_or_default(speakers: DataFrame, assigned: DataFrame, default: str, id_col: str = "doc_id") -> DataFrame:
    """Speakers with the voice that was assigned to them, else the default."""
    return speakers.join(assigned, [id_col, "speaker"], "left").withColumn("voice_id", F.coalesce("voice_id", F.lit(default)))
