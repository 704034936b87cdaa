"""Books as files of pages: texts parted by form feeds, read by Spark's own text source, and any other format through a data
source with planned partitions, a decoder of the user's and a second one for pages whose text is poor.

A book is a folder; its files follow each other by path, and a page's number is its place in its file after the pages of the
files before, which one small row per file (or split) carries in. Texts are not moved to be numbered.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from importlib import import_module
from zipfile import ZipFile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions.text import strip
from quillspark.operators.lines import low_quality

FEED = "\f"
SCHEMA = "path string, at int, text string, images int"
LEAST = 100  # characters of a page's text, below which the second source is asked
SPLIT_MB, BATCH_ROWS = 64, 256


def blank_page(text: Column, images: Column) -> Column:
    """Neither text nor images; unknown ones count as none."""
    return (F.coalesce(F.length(strip(text)), F.lit(0)) == 0) & (F.coalesce(images, F.lit(0)) == 0)


def with_second_source(pages: DataFrame, second: DataFrame, on: list[str], least: int = LEAST) -> DataFrame:
    """`pages` with the text of `second` (the columns `on`, text) where their own is poor and it has one; other pages are not
    joined, so that their texts stay where they are. Of repeated rows of `second` the least text counts."""
    poor = low_quality(F.col("text"), least)
    texts = second.groupBy(*on).agg(F.min("text").alias("second_"))
    asked = pages.where(poor).join(texts, on, "left").withColumn("text", F.coalesce("second_", "text")).select(*pages.columns)
    return pages.where(~poor).unionByName(asked)


def write_pages(pages: DataFrame, path: str, file_pages: int = 500) -> None:
    """Pages (source, page_idx, text) as files of `file_pages` pages, each book in a folder; form feeds within a page become
    spaces, null texts empty pages."""
    block = F.lpad(F.expr(f"page_idx div {file_pages}").cast("string"), 9, "0")
    value = F.translate(F.coalesce("text", F.lit("")), FEED, " ")
    rows = pages.select("source", block.alias("block"), "page_idx", value.alias("value")).repartition("source", "block").sortWithinPartitions("source", "block", "page_idx")
    rows.drop("page_idx").write.partitionBy("source", "block").option("lineSep", FEED).text(path)


def placed(rows: DataFrame, part: list[str]) -> DataFrame:
    """Rows (path, at, ...) with `book`, the folder above `block=`, and `page_idx`: `at` after the rows of the parts before, which
    ascend by `part`."""
    rows = rows.withColumn("book", F.regexp_replace("path", r"(/block=[^/]*)?/[^/]*$", ""))
    counts = rows.groupBy("book", *part).agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row per file or split
    before = Window.partitionBy("book").orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("book", *part, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["book", *part]).withColumn("page_idx", (F.col("at") - F.col("first") + F.col("start")).cast("int")).drop("first", "start", "at")


def feed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(book, path, text, page_idx) of files whose pages end in form feeds. Large files are read in splits: a split's rows have
    rising numbers, its first one is known from the counts."""
    raw = spark.read.option("lineSep", FEED).option("recursiveFileLookup", "true").text(folder)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return placed(rows, ["path", "split"]).drop("split")


def decoded_pages(spark: SparkSession, folder: str, decoder: str, fallback: str | None = None, suffix: str = "", split_mb: int = SPLIT_MB) -> DataFrame:
    """(book, path, text, images, page_idx) by a decoder named `module:function`, see `PageReader`."""
    spark.dataSource.register(PageSource)
    options = {"path": folder, "decoder": decoder, "suffix": suffix, "splitMb": str(split_mb)} | ({"fallback": fallback} if fallback else {})
    return placed(spark.read.format("quill_pages").options(**options).load(), ["path"])


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


class Pages(InputPartition):
    """Files of one task: (path, share, shares), of a file's pages the share from `share` / `shares` on."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def plan(files: list[tuple[str, int]], most: int) -> list[list[tuple[str, int, int]]]:
    """Files (path, bytes) dealt to tasks of about `most` bytes: small ones together, large ones in shares."""
    out, held, size = [], [], 0
    for path, n in files:
        shares = max(1, -(-n // most))
        if shares > 1:
            out += [[(path, k, shares)] for k in range(shares)]
            continue
        if held and size + n > most:
            out.append(held)
            held, size = [], 0
        held.append((path, 0, 1))
        size += n
    return out + ([held] if held else [])


class PageReader(DataSourceReader):
    """Options: path (of any store that Arrow reads), decoder, fallback, suffix, splitMb, least.

    The decoder is called with an open file and gives its pages as a sequence of (text, number of images), of which a task
    only takes its share; the fallback is called with the file and a page's place, for pages with fewer than `least`
    characters, and gives their text, or None to keep the first. Names are those of importable functions.
    """

    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.suffix, self.least = low["path"], low.get("suffix", ""), int(low.get("least", LEAST))
        self.decoder, self.fallback = low["decoder"], low.get("fallback")
        self.most = int(float(low.get("splitmb", SPLIT_MB)) * (1 << 20))

    def partitions(self) -> list[Pages]:
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".")))
        return [Pages(x) for x in plan(files, self.most)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        decode, again = named(self.decoder), named(self.fallback) if self.fallback else None
        rows: list[tuple] = []
        for path, share, shares in partition.files:
            with store.open_input_file(path) as f:
                file = io.BufferedReader(Handle(f))
                pages = decode(file)
                for at in range(len(pages) * share // shares, len(pages) * (share + 1) // shares):
                    text, images = pages[at]
                    if again and len((text or "").strip()) < self.least:
                        other = again(file, at)
                        text = text if other is None else other
                    rows.append((path, at, text, images))
                    if len(rows) == BATCH_ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)


class Handle(io.RawIOBase):
    """An Arrow file as Python's own kind, whose places before the start raise OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        at = to + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("a place before the start")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, out) -> int:
        data = self.file.read(len(out))
        out[: len(data)] = data
        return len(data)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["path", "at", "text", "images"])


def named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


# --- decoders ---


def feed_decoder(file) -> list[tuple[str, int]]:
    """Pages of a text file that end in form feeds; no images."""
    parts = file.read().decode("utf-8", "replace").split(FEED)
    return [(p, 0) for p in (parts[:-1] if parts[-1] == "" else parts)]


class ZipPages:
    """An archive with a text `<page>.txt` per page, in order of name, and images `<page>-<anything>`; a page is read when asked."""

    def __init__(self, file):
        self.zip = ZipFile(file)
        names = self.zip.namelist()
        self.texts = sorted(n for n in names if n.endswith(".txt"))
        self.images = [n.rpartition("/")[2].partition("-")[0] for n in names if not n.endswith(".txt") and "-" in n]

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, k: int) -> tuple[str, int]:
        page = self.texts[k].rpartition("/")[2].removesuffix(".txt")
        return self.zip.read(self.texts[k]).decode("utf-8", "replace"), self.images.count(page)


def zip_decoder(file) -> ZipPages:
    return ZipPages(file)
