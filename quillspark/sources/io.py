"""Sources and sinks: tables, folders of texts and media files, JSON profiles, chapter files, manifests and playlists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = {"audio": ["mp3", "wav", "m4a", "ogg", "flac"], "image": ["png", "jpg", "jpeg", "bmp", "gif", "webp"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the *.txt files of a folder; order by path where order matters."""
    return spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def media_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(path, length) of the files with an extension of the kind, in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(MEDIA[kind]))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw PDF bytes, for an outside decoder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)


def voice_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """JSON profiles by quality, best first; missing fields get defaults."""
    raw = spark.read.schema("name string, quality double, created string, clips int").option("multiLine", "true").json(folder)
    return raw.select(F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce("created", F.lit("")).alias("created"), F.coalesce("clips", F.lit(0)).alias("clips")).orderBy(F.desc("quality"), "name")


def header_values(rows: DataFrame) -> DataFrame:
    """Title and author read back from lines `Title: ` and `Author: `; the last of each holds. Rows: (doc_id, line_no, line)."""
    of = lambda p: F.max_by(F.when(F.col("line").startswith(p), F.expr(f"substring(line, {len(p) + 1})")), F.when(F.col("line").startswith(p), F.col("line_no")))
    return rows.groupBy("doc_id").agg(of("Title: ").alias("title"), of("Author: ").alias("author"))


def write_chapters(chapters: DataFrame, path: str) -> None:
    """One folder per document, a text of header, content and newline per row. Chapters: (doc_id, title, content); whole files
    with names, headers and endings are `plans.reports.chapter_texts`."""
    body = F.concat(F.lit("=== "), "title", F.lit(" ===\n\n"), F.trim("content"), F.lit("\n"))
    chapters.select("doc_id", body.alias("value")).write.partitionBy("doc_id").mode("overwrite").text(path)


def manifest(speakers: DataFrame) -> DataFrame:
    """(doc_id, manifest): speakers as JSON, in order of name."""
    return speakers.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("speaker", "dialogues", "n_words")))).alias("manifest"))


def playlist(clips: DataFrame) -> DataFrame:
    """(doc_id, m3u8): entries in order, 300 s where the duration is unknown. Clips: (doc_id, ord, title, seconds, path)."""
    entry = F.concat(F.lit("#EXTINF:"), F.coalesce(F.col("seconds").cast("int"), F.lit(300)).cast("string"), F.lit(","), "title", F.lit("\n"), "path")
    g = clips.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e")))).alias("x"))
    return g.select("doc_id", F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform("x", lambda s: s["e"]), "\n"), F.lit("\n#EXT-X-ENDLIST\n")).alias("m3u8"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to a scratch folder, so that what reads them several times makes them once."""
    folder = scratch_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
