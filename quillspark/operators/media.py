"""Metadata of clips, images and voices: gates, scores, fits, name handling and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import contains_any, keyword_class, strip, title_case
from quillspark.operators.speakers import foremost

CLONED_MARKS = ["(Cloned)", "cloned_", "🎬", "(Custom)"]  # fixed values
PREVIEW_TAIL = " This voice will be used throughout your entire audiobook to bring the story to life. The natural flow and intonation will make your content engaging and professional."  # fixed value
WIDTH, HEIGHT = 1920, 1080


def is_cloned(name: Column) -> Column:
    return contains_any(name, CLONED_MARKS)


def clean_voice_name(name: Column) -> Column:
    """Display name without marks; a `cloned_` id becomes capitalised words."""
    plain = strip(F.replace(F.replace(name, F.lit("🎬 "), F.lit("")), F.lit(" (Cloned)"), F.lit("")))
    return F.when(plain.startswith("cloned_"), title_case(F.replace(F.replace(plain, F.lit("cloned_"), F.lit("")), F.lit("_"), F.lit(" ")))).otherwise(plain)


def preview_text(text: Column) -> Column:
    return F.when(F.length(text) < 100, F.concat(text, F.lit(PREVIEW_TAIL))).otherwise(F.left(text, F.lit(500)))


def metadata_value(value: Column, unwanted: list[str] | None = None) -> Column:
    """A stripped metadata value, null if blank or one of the unwanted."""
    v = strip(value)
    return F.when((v != "") & ~F.lower(v).isin(unwanted or [""]), v)


def length_tier(seconds: Column) -> Column:
    return F.when(seconds >= 45, "excellent").when(seconds >= 30, "good").otherwise("short")


def clone_quality(test_s: Column, reference_s: Column, volume_gap: Column) -> Column:
    """0.3 of speaking rate, 0.3 of volume, and 0.4 of a constant 0.7; 0.5 where a length is unknown or zero."""
    expected = reference_s * 0.8
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(test_s - expected) / expected))
    volume = 1 - F.least(volume_gap / 20.0, F.lit(1.0))
    return F.when(reference_s > 0, rate * 0.3 + volume * 0.3 + F.lit(0.7) * 0.4).otherwise(0.5)


def profile_quality(clips: Column) -> Column:
    return F.least(clips / 10.0, F.lit(1.0))


def trimmed_clips(clips: DataFrame, id_col: str, most: int, least_s: float = 3.0, most_s: float = 30.0) -> DataFrame:
    """The first clips that are long enough, cut to the greatest length."""
    k = F.row_number().over(Window.partitionBy(id_col).orderBy("clip_no"))
    return clips.where(F.col("duration_s") >= least_s).withColumn("k", k).where(F.col("k") <= most).drop("k").withColumn("duration_s", F.least("duration_s", F.lit(most_s)))


def repeated_sample(filled: DataFrame, id_col: str = "conv_id", target: float = 60.0, gap: float = 0.2, again: float = 0.3) -> DataFrame:
    """(id, clips, total_s): the filled clips, each with a gap, and the same clips again in order, with longer gaps, while the
    total is below the target. Clips are added one by one: a total that should be the target itself may be one bit less."""
    rows = filled.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "duration_s"))).alias("x"))
    rows = rows.withColumn("own", F.aggregate("x", F.lit(0.0), lambda a, c: a + (c["duration_s"] + gap))).withColumn("round", F.aggregate("x", F.lit(0.0), lambda a, c: a + c["duration_s"] + again))
    rounds = F.when((F.col("own") < target) & (F.col("round") > 0), F.floor((F.lit(target) - F.col("own")) / F.col("round")) + 2).otherwise(1).cast("int")  # one more than are needed

    def add(a: Column, c: Column) -> Column:
        return F.when(a["t"] >= target, a).otherwise(F.struct((a["t"] + c["duration_s"] + again).alias("t"), (a["n"] + 1).alias("n")))

    total = F.aggregate(F.sequence(F.lit(1), rounds), F.struct(F.col("own").alias("t"), F.size("x").alias("n")), lambda a, _: F.aggregate(F.col("x"), a, add))
    return rows.select(id_col, total.alias("r")).select(id_col, F.col("r.n").alias("clips"), F.col("r.t").alias("total_s"))


def clip_totals(clips: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, total_clips, total_duration, rms, max_amplitude, quality): of a voice's clips (id, clip_no, duration_s, rms,
    max_amplitude); the duration to 2 places, the mean rms."""
    return clips.groupBy(id_col).agg(
        F.count("*").alias("total_clips"), F.round(F.sum("duration_s"), 2).alias("total_duration"), F.avg("rms").alias("rms"), F.max("max_amplitude").alias("max_amplitude"), profile_quality(F.count("*")).alias("quality")
    )


def chapter_of_file(stem: Column, ordinal: Column) -> Column:
    """(number, title) of a media file: the number its name has, else its place; `Chapter n`, and what is left of a longer name."""
    number = F.coalesce(F.nullif(F.regexp_extract(F.lower(stem), r"chapter[_\s]*(\d+)", 1), F.lit("")), ordinal.cast("string"))
    rest = title_case(F.replace(F.regexp_replace(stem, r"(?i)chapter[_\s]*\d+[_\s]*", ""), F.lit("_"), F.lit(" ")))
    title = F.concat(F.lit("Chapter "), number, F.when((F.length(stem) > 10) & (rest != ""), F.concat(F.lit(": "), F.left(rest, F.lit(50)))).otherwise(""))
    return F.struct(number.alias("number"), title.alias("title"))


def slide_seconds(audio_s: Column, images: Column, least: float = 2.0, default: float = 5.0) -> Column:
    """(planned, shown): seconds a slide is announced for, `least` or more, and seconds it is shown; `default` without images."""
    each = audio_s / F.when(images > 0, images)
    return F.struct(F.when(images > 0, F.greatest(each, F.lit(least))).otherwise(default).alias("planned"), each.alias("shown"))


def united_catalog(catalogs: list[DataFrame]) -> DataFrame:
    """(name, voice, ord): entries (name, voice) of catalogs one after the other; of a name, the place is that of its first
    entry and the value that of its last."""
    rows = None
    for i, c in enumerate(catalogs):
        c = c.select("name", "voice", F.struct(F.lit(i).alias("source"), F.col("ord").alias("at")).alias("o"))
        rows = c if rows is None else rows.unionByName(c)
    g = rows.groupBy("name").agg(F.max_by("voice", "o").alias("voice"), F.min("o").alias("o"))
    return g.select("name", "voice", F.col("o.source").alias("source"), F.col("o.at").alias("at"))


def voices_by_slug(asked: DataFrame, cloned: DataFrame, default: str | None = None) -> DataFrame:
    """(voice_id, name): the first cloned entry (ord, name) whose slug the asked id has after `cloned_`; else the default."""
    slug = F.replace(F.lower("name"), F.lit(" "), F.lit("_"))
    first = cloned.groupBy(slug.alias("slug")).agg(F.min_by("name", "ord").alias("name"))
    out = asked.join(first, F.replace("voice_id", F.lit("cloned_"), F.lit("")) == F.col("slug"), "left")
    return out.select("voice_id", F.coalesce("name", F.lit(default)).alias("name"))


def synthesis_gate(chunks: DataFrame, least: int = 10) -> DataFrame:
    """Chunks (doc_id, chunk_no, chunk) that are long enough to be spoken; their count of characters without margins."""
    return chunks.withColumn("n_chars", F.length(strip(F.col("chunk")))).where(F.col("n_chars") >= least)


def output_gate(rendered: DataFrame, least_ms: int = 1000, least_bytes: int = 1024) -> DataFrame:
    """(doc_id, chunks, succeeded, total_ms, accepted): successes of a document's rendered chunks (doc_id, chunk_no, ok, ms,
    bytes), and whether its audio is longer than `least_ms` and larger than `least_bytes`."""
    ok = F.col("ok")
    g = rendered.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.when(ok, 1).otherwise(0)).alias("succeeded"), F.sum(F.when(ok, F.col("ms")).otherwise(0)).alias("total_ms"), F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("total_bytes"))
    return g.withColumn("accepted", (F.col("total_ms") > least_ms) & (F.col("total_bytes") > least_bytes)).drop("total_bytes")


def fit_image(width: Column, height: Column, out_w: int = WIDTH, out_h: int = HEIGHT) -> Column:
    """(w, h, x, y): size and offsets of an image inside the frame, aspect kept."""
    scale = F.least(F.lit(float(out_w)) / width, F.lit(float(out_h)) / height)
    w, h = F.floor(width * scale).cast("int"), F.floor(height * scale).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((out_w - w) / 2).cast("int").alias("x"), F.floor((out_h - h) / 2).cast("int").alias("y"))


def scored_voices(ranked: DataFrame, catalog: list[tuple[str, str, str]] = P.SCORED_VOICES, id_col: str = "doc_id", classes: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One voice per speaker, none twice, in order of dialogues plus words / 100: the voice whose description scores
    highest by the speaker's traits, the first of equals. Each speaker gets one while any is left, so it is a fold over as many
    of a text's speakers as there are voices.

    `classes`: keywords of names by class, the first class that fits; a voice of that class scores 10 more. None by default,
    since a guess from a name is often wrong.
    """
    weight = -(F.col("dialogues") + F.col("n_words") / 100)
    ranked = foremost(ranked, weight, len(catalog), id_col)
    rows = ranked.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(weight.alias("w"), "first", "speaker", "formality", "excitement", "calmness"))).alias("x"))
    voices = F.array(*[F.struct(F.lit(-i).alias("o"), F.lit(v).alias("id"), F.lit(c).alias("c"), F.lit(d.lower()).alias("d")) for i, (v, c, d) in enumerate(catalog)])
    has = lambda v, *ws: contains_any(v["d"], list(ws))

    def step(a, s):
        def score(v):
            trait = F.when(s["formality"] > 0.7, has(v, "professional", "authoritative")).when(s["excitement"] > 0.6, has(v, "bright", "dynamic")).when(s["calmness"] > 0.6, has(v, "calm", "gentle", "soft")).otherwise(False)
            narrator = (F.lower(s["speaker"]) == "narrator") & has(v, "narrator", "clear")
            alike = (keyword_class(s["speaker"], classes, "") == v["c"]) if classes else F.lit(False)
            return F.when(alike, 10).otherwise(0) + F.when(trait, 5).otherwise(0) + F.when(narrator, 8).otherwise(0)

        free = F.filter(voices, lambda v: ~F.array_contains(a["used"], v["id"]))
        best = F.array_max(F.transform(free, lambda v: F.struct(score(v).alias("s"), v["o"].alias("o"), v["id"].alias("id"))))["id"]
        return F.when(best.isNull(), a).otherwise(F.struct(F.concat(a["used"], F.array(best)).alias("used"), F.concat(a["out"], F.array(F.struct(s["speaker"].alias("speaker"), best.alias("voice_id")))).alias("out")))

    zero = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<speaker:string,voice_id:string>>").alias("out"))
    return rows.select(id_col, F.explode(F.aggregate("x", zero, step, lambda a: a["out"])).alias("o")).select(id_col, "o.*")
