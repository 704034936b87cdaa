"""Planning tables: voices, captions, clips, images, presets and the render timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import duration_estimate, n_words, strip
from quillspark.operators.chunking import pack_trailing

LEAD_MS, GAP_MS = 500, 300
# Silences of a timeline in milliseconds: at the start, before each chunk but the first, after each chunk, after the last. Fixed values.
PROFILES = {"basic": (500, 0, 500, 500), "flowing": (300, 0, 200, 300), "direct": (500, 0, 300, 300), "enhanced": (300, 400, 0, 0), "preview": (100, 0, 100, 100)}
SHORTEST = {"enhanced": 10}  # characters of a chunk that a profile leaves out below


def render_plan(docs: DataFrame, voices: list[str], most: int = 250, least: int = 20) -> DataFrame:
    """(doc_id, chunk_no, voice_id, n_chars, est_ms, start_ms, end_ms): chunks in turn over the voices, after a leading silence, with gaps."""
    chunks = docs.select("doc_id", F.posexplode(pack_trailing(F.col("text"), most, least)).alias("chunk_no", "chunk"))
    voice = F.element_at(F.array(*[F.lit(v) for v in voices]), F.col("chunk_no") % len(voices) + 1)
    est = (duration_estimate(F.length("chunk")) * 1000).cast("long")
    rows = chunks.select("doc_id", "chunk_no", voice.alias("voice_id"), F.length("chunk").alias("n_chars"), est.alias("est_ms"))
    before = Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    start = LEAD_MS + F.coalesce(F.sum(F.col("est_ms") + GAP_MS).over(before), F.lit(0))
    return rows.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("est_ms"))


def timelines(chunks: DataFrame, profiles: list[str], id_col: str = "doc_id") -> DataFrame:
    """`chunks` (id, chunk_no from 0, chunk) with profile, est_ms, start_ms, end_ms and total_ms, the text's whole length, a row
    per profile, by its silences. The last chunk is the one with the greatest number, whether the profile leaves others out or
    not. Chunks are made and exchanged once for all profiles."""
    whole = Window.partitionBy(id_col)
    ahead = whole.orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(strip(F.col("chunk")))
    rows = chunks.withColumns({"est_ms": (duration_estimate(F.length("chunk")) * 1000).cast("long"), "kept_": F.array(*[n >= SHORTEST.get(p, 0) for p in profiles])})
    rows = rows.withColumn("last_", F.max("chunk_no").over(whole))
    of = []
    for i, p in enumerate(profiles):
        lead, before, after, last = PROFILES[p]
        pre = F.when(F.col("chunk_no") > 0, before).otherwise(0)
        own = F.when(F.col("kept_")[i], pre + F.col("est_ms") + F.when(F.col("chunk_no") == F.col("last_"), last).otherwise(after))
        start = lead + F.coalesce(F.sum(own).over(ahead), F.lit(0)) + pre
        of.append(F.when(F.col("kept_")[i], F.struct(F.lit(p).alias("profile"), start.alias("start_ms"), (start + F.col("est_ms")).alias("end_ms"), (lead + F.sum(own).over(whole)).alias("total_ms"))))
    out = rows.withColumn("of_", F.array(*of)).withColumn("of_", F.explode(F.filter("of_", lambda x: x.isNotNull())))
    return out.select("*", "of_.*").drop("last_", "kept_", "of_")


def timeline(chunks: DataFrame, profile: str, id_col: str = "doc_id") -> DataFrame:
    """`timelines` of one profile."""
    return timelines(chunks, [profile], id_col).drop("profile")


def diarize(captions: DataFrame, gap: float, id_col: str = "video_id") -> DataFrame:
    """Two speakers in turn, changing at gaps over `gap` seconds; blank captions are left out before. (id, ord, start, duration, text)."""
    spoken = captions.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    order = Window.partitionBy(id_col).orderBy("ord")
    pause = F.col("start") - F.lag(F.col("start") + F.col("duration"), 1, 0.0).over(order)
    turned = spoken.withColumn("pause", pause).withColumn("turns", F.sum((F.col("pause") > gap).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return turned.withColumn("speaker", F.concat(F.lit("Speaker "), (F.col("turns") % 2 + 1).cast("string"))).drop("pause", "turns")


def caption_speakers(captions: DataFrame, gap: float, least: int = 10, id_col: str = "video_id") -> DataFrame:
    found = diarize(captions, gap, id_col).groupBy(id_col, "speaker").agg(F.sum(n_words(F.col("text"))).alias("n_words"), F.count("*").alias("captions"))
    return found.where(F.col("n_words") > least)


def fill_sample(clips: DataFrame, target: float = 60.0, gap: float = 0.2, id_col: str = "conv_id") -> DataFrame:
    """Clips of 2 to 10 s, longest first, while what is laid down before them is below `target`. (id, clip_no, duration_s)."""
    order = Window.partitionBy(id_col).orderBy(F.desc("duration_s"), "clip_no")
    fit = clips.where(F.col("duration_s").between(2, 10)).withColumn("rank", F.row_number().over(order))
    laid = F.coalesce(F.sum("duration_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + (F.col("rank") - 1) * gap
    return fit.withColumn("start_s", laid).where(F.col("start_s") < target)


def clip_scores(clips: DataFrame) -> DataFrame:
    """Closeness to 12 s, evenness and mean of both; needs duration_s and deviation."""
    close = F.greatest(F.lit(0.0), 1 - F.abs(F.col("duration_s") - 12.0) / 12.0)
    even = 1 / (1 + F.col("deviation") / 10.0)
    return clips.withColumn("score", (close + even) / 2)


def best_clips(clips: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The clip with the highest score, the first of equals."""
    return clip_scores(clips).groupBy(id_col).agg(F.max_by("clip_no", F.struct("score", -F.col("clip_no"))).alias("clip_no"), F.max("score").alias("score"))


def global_index(rows: DataFrame, key: str, name: str, parts: int = 64) -> DataFrame:
    """`rows` with their place from 0 in the order of a numeric key, which is unique: places within ranges of the key, after the
    counts of the ranges before."""
    cuts = rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.01)
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + F.when(F.col(key) > c, 1).otherwise(0)
    dealt = rows.withColumn("part_of", part)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows
    counts = dealt.groupBy(F.col("part_of").alias("p")).agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part_of").orderBy(key)) - 1
    return dealt.withColumn(name, place).join(F.broadcast(counts), F.col("part_of") == F.col("p")).withColumn(name, (F.col(name) + F.col("start")).cast("long")).drop("part_of", "p", "start")


def slice_images(images: DataFrame, chapters: DataFrame, faithful: bool = True) -> DataFrame:
    """Images of each chapter: equal slices, the last takes the rest. Images (img_idx), chapters (chapter_no from 1).

    The faithful variant takes the 1-based number as 0-based, so the first slice is used by none.
    """
    n, k = images.count(), chapters.count()
    per = n // k if k else 0
    c = F.col("chapter_no") - (0 if faithful else 1)
    last = F.col("chapter_no") == k
    ranges = chapters.select("chapter_no", (c * per).alias("lo"), F.when(last, n).otherwise((c + 1) * per).alias("hi")).where("lo < hi")
    return ranges.withColumn("img_idx", F.explode(F.expr("sequence(lo, hi - 1)"))).select("chapter_no", F.col("img_idx").cast("long").alias("img_idx")).join(images, "img_idx")


def kept_images(images: DataFrame) -> DataFrame:
    """Images worth keeping: 100 px a side, not a whole page, aspect up to 25, a known extension, little text. Needs
    (doc, page_idx, width, height, ext, text_chars); the average page is that of the first five, 600 without any."""
    page = images.where("page_idx < 5").groupBy("doc").agg(F.avg("width").alias("pw"), F.avg("height").alias("ph"))
    x = images.join(page, "doc", "left").withColumns({"pw": F.coalesce("pw", F.lit(600.0)), "ph": F.coalesce("ph", F.lit(600.0))})
    whole = (F.col("width") > 0.85 * F.col("pw")) & (F.col("height") > 0.85 * F.col("ph"))
    aspect = F.greatest("width", "height") / F.least("width", "height")
    return x.where((F.least("width", "height") >= 100) & ~whole & (aspect <= 25) & F.lower("ext").isin("png", "jpg", "jpeg") & (F.col("text_chars") < 200)).drop("pw", "ph")


def scaled_presets(presets: DataFrame, intensity: float) -> DataFrame:
    """Temperature (1 at most), top-k and speed by intensity."""
    return presets.select(
        "style", F.least(F.lit(1.0), F.col("temperature") * (0.7 + 0.3 * intensity)).alias("temperature"),
        (F.col("top_k") * (0.8 + 0.2 * intensity)).cast("int").alias("top_k"), (F.col("speed") * (0.9 + 0.1 * intensity)).alias("speed"),
    )


def grams(text: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containments(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large): the texts of more than three characters of `small` (low) that occur within texts of `large` (low).

    An inverted index of the large texts' trigrams is asked for each small text's rarest one only; what it gives is compared.
    """
    index = large.select(F.col("low").alias("large"), F.explode(grams(F.col("low"), 3)).alias("g"))
    times = index.groupBy("g").agg(F.count("*").alias("n"))
    rarest = small.where(F.length("low") > 3).select(F.col("low").alias("small"), F.explode(grams(F.col("low"), 3)).alias("g")).join(times, "g")
    rarest = rarest.groupBy("small").agg(F.min(F.struct("n", "g")).alias("r")).select("small", F.col("r.g").alias("g"))
    return rarest.join(index, "g").where(F.contains("large", F.col("small"))).select("small", "large")


def fuzzy_voice(queries: DataFrame, catalog: DataFrame, exact_first: bool = False) -> DataFrame:
    """The first catalog entry (ord, name) whose name equals, contains or is contained in the query, without regard to case;
    with `exact_first` an equal one before all others. Null names are no entries, null queries find nothing; an empty name or
    query is within every other.

    Texts of up to three characters are looked up among the other side's substrings of that length; longer ones by trigrams.
    """
    names = catalog.where("name IS NOT NULL").groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("ord", "name")).alias("f"))
    asked = queries.where("query IS NOT NULL").select(F.lower("query").alias("low")).distinct()
    short = lambda c: F.concat(*[grams(c, n) for n in (1, 2, 3)])
    by_name = names.withColumnRenamed("low", "name_low")
    found = containments(names, asked).select(F.col("large").alias("low"), F.col("small").alias("name_low")).join(by_name, "name_low").select("low", "name_low", "f")
    within = asked.select("low", F.explode(short(F.col("low"))).alias("name_low")).join(by_name, "name_low").select("low", "name_low", "f")
    around = containments(asked, names).select(F.col("small").alias("low"), F.col("large").alias("name_low")).join(by_name, "name_low").select("low", "name_low", "f")
    firsts = names.select("f", F.explode(short(F.col("low"))).alias("low")).groupBy("low").agg(F.min("f").alias("f"))  # of the names with a short text in them
    shorts = asked.join(firsts, "low").select("low", F.lit(None).cast("string").alias("name_low"), "f")
    found = found.unionByName(within).unionByName(around).unionByName(shorts)
    first, empty = names.agg(F.min("f").alias("f")).where("f IS NOT NULL"), by_name.where("name_low = ''").select("f")  # a row each
    found = found.unionByName(asked.where("low = ''").join(F.broadcast(first)).select("low", F.lit(None).cast("string").alias("name_low"), "f"))
    found = found.unionByName(asked.join(F.broadcast(empty)).select("low", F.lit("").alias("name_low"), "f"))
    rank = F.struct(F.when((F.col("low") == F.col("name_low")) & F.lit(exact_first), 0).otherwise(1).alias("e"), F.col("f.ord").alias("ord"))
    best = found.groupBy("low").agg(F.min_by("f.name", rank).alias("name"))
    return queries.withColumn("low_", F.lower("query")).join(best, F.col("low_") == F.col("low"), "left").select("query", "name")
