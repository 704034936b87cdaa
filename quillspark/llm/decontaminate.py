"""Benchmark decontamination with a distributed positional inverted index.

1. Windows of benchmark items are made distinct. The posting lengths of their terms are counted over all documents; a
   window with a term that no document has is dropped.
2. A window's SIGNATURE rarest terms are its signature. Windows whose signatures have equal terms at equal distances share
   a probe, so that passages common to many items are looked up once.
3. The index is stored once: the postings (term, document, position) of all signature terms, and each document's count
   of words. A term's postings are a row each, spread over the whole table, so a frequent term has no place of its own.
4. A probe starts from the postings of its rarest term. The list of each further term, moved by its distance, is
   intersected by an equality join on document, term and position; with `slop`, on neighbouring blocks of positions.
5. What is left names the windows and places, which an exact check compares with the documents' words. Proximity
   matches are those whose signature terms all stand within `slop` words of their places.

Small tables of the benchmark are broadcast if their bytes, which are measured, allow it; else all joins shuffle.

Defined results: null and empty texts have no words and are clean; items without words are never found, and null items are
named by no id; items shorter than a window are one window; terms of equal frequency are taken in order of term and place;
repeated documents each get their result (rows are matched by id and text hash); other columns may have any name; an empty
benchmark leaves all documents clean; empty documents give an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import forget, materialize, small_enough, table, words_of

WINDOW = 10
SIGNATURE = 3
SLOP = 3
BLOCK = 8  # positions that a proximity search compares


def maybe_broadcast(df: DataFrame, mb: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df, mb) else df


def windows_of(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, window): distinct windows as arrays of words; (wid, item_id): the items that have them."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    w = w.select("item_id", "words", F.explode(F.expr(f"sequence(0, greatest(size(words) - {width}, 0))")).alias("at"))
    each = materialize(w.select("item_id", F.expr(f"slice(words, at + 1, {width})").alias("window")).distinct(), "bench-each")
    windows = materialize(each.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "bench-windows")
    owners = each.where("item_id IS NOT NULL").join(windows, "window").select("wid", "item_id")
    owners = materialize(owners, "bench-owners")
    forget(each)
    return windows, owners


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def posting_lengths(docs: DataFrame, terms: DataFrame, mb: int = 16) -> DataFrame:
    """(term, n): how many postings each of the terms has in the documents; terms without any are left out."""
    every = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return materialize(every.join(maybe_broadcast(terms, mb), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), "bench-lengths")


def positional_index(docs: DataFrame, terms: DataFrame, mb: int = 16) -> DataFrame:
    """The stored index: postings (term, doc_id, h, n_words, pos) of the terms, and a row without a term for each document."""
    rows = keyed(docs).select("doc_id", "h", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "h", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    found = rows.join(maybe_broadcast(terms.select("term"), mb), F.col("word") == F.col("term"), "left")
    found = found.where("term IS NOT NULL OR coalesce(pos, 0) = 0")
    # a document's first word may be a term: its row then stands for both
    out = found.select("doc_id", "h", "n_words", "term", "pos", F.expr("coalesce(pos, 0) = 0").alias("head"))
    return materialize(out, "bench-index")


def signatures(windows: DataFrame, lengths: DataFrame, terms: int = SIGNATURE, mb: int = 16) -> DataFrame:
    """(wid, window, sig): the rarest (n, term, offset) of each window whose terms all occur."""
    each = windows.select("wid", "window", F.posexplode("window").alias("offset", "term"))
    sig = each.join(maybe_broadcast(lengths, mb), "term").groupBy("wid", "window").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("sig"))
    return sig.where("size(sig) = size(window)").select("wid", "window", F.slice("sig", 1, terms).alias("sig"))


def probes_of(sig: DataFrame, terms: int = SIGNATURE) -> tuple[DataFrame, DataFrame]:
    """(pid, t0, t1, d1, ...): distinct probes, terms with their distances from the rarest; (wid, pid, window, offset)."""
    cols = [F.col("sig")[0]["term"].alias("t0"), F.col("sig")[0]["offset"].alias("offset")]
    for k in range(1, terms):
        s = F.get("sig", F.lit(k))
        cols += [s["term"].alias(f"t{k}"), (s["offset"] - F.col("sig")[0]["offset"]).alias(f"d{k}")]
    flat = sig.select("wid", "window", *cols)
    keys = ["t0", *[f"{x}{k}" for k in range(1, terms) for x in "td"]]
    probes = materialize(flat.select(*keys).distinct().withColumn("pid", F.monotonically_increasing_id()), "bench-probes")
    same = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys]
    named = probes.select("pid", *[F.col(k).alias(f"p_{k}") for k in keys])
    on = same[0]
    for c in same[1:]:
        on = on & c
    return probes, materialize(flat.join(named, on).select("wid", "pid", "window", "offset"), "bench-places")


def search(index: DataFrame, probes: DataFrame, slop: int = 0, terms: int = SIGNATURE, mb: int = 16) -> DataFrame:
    """(doc_id, h, pid, pos, n_words, off): places of a probe's rarest term where all its lists meet within `slop` words, and the
    greatest distance of a term from its place."""
    postings = index.where("term IS NOT NULL").select("doc_id", "h", "n_words", "term", "pos")
    now = postings.join(maybe_broadcast(probes, mb), F.col("term") == F.col("t0")).drop("term", "t0").withColumn("off", F.lit(0))
    lists = postings.select(F.col("doc_id").alias("l_id"), F.col("h").alias("l_h"), F.col("term").alias("l_term"), F.col("pos").alias("l_pos"))
    same = F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h"))
    for k in range(1, terms):
        t, at = f"t{k}", F.col("pos") + F.col(f"d{k}")
        done, todo = now.where(F.col(t).isNull()), now.where(F.col(t).isNotNull() & (at > -1 - slop) & (at < F.col("n_words") + slop))
        keep = [c for c in now.columns if c not in (t, f"d{k}")]
        if slop:
            blocks = F.expr(f"sequence(floor((pos + d{k} - {slop}) / {BLOCK}), floor((pos + d{k} + {slop}) / {BLOCK}))")
            near = todo.withColumn("block", F.explode(blocks)).join(lists.withColumn("l_block", F.floor(F.col("l_pos") / BLOCK)), same & (F.col(t) == F.col("l_term")) & (F.col("block") == F.col("l_block")))
            near = near.withColumn("gap", F.abs(F.col("l_pos") - at)).where(F.col("gap") <= slop)
            rest = [c for c in keep if c != "off"]
            met = near.groupBy(*rest).agg(F.min(F.greatest("off", "gap")).cast("int").alias("off")).select(*keep)
        else:
            met = todo.join(lists, same & (F.col(t) == F.col("l_term")) & (at == F.col("l_pos")), "left_semi").select(*keep)
        now = done.select(*keep).unionByName(met)
    return now


def find(docs: DataFrame, items: DataFrame, width: int, slop: int, mb: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The stored index; (wid, item_id); the windows (wid, pid, window, offset); and what `search` finds."""
    windows, owners = windows_of(items, width)
    terms = materialize(windows.select(F.explode("window").alias("term")).distinct(), "bench-terms")
    lengths = posting_lengths(docs, terms, mb)
    sig = materialize(signatures(windows, lengths, mb=mb), "bench-signatures")
    probes, places = probes_of(sig)
    wanted = materialize(sig.select(F.explode("sig.term").alias("term")).distinct(), "bench-wanted")
    index = positional_index(docs, wanted, mb)
    forget(windows, terms, lengths, sig, wanted)
    return index, owners, places, search(index, probes, slop, mb=mb)


def find_windows(docs: DataFrame, items: DataFrame, width: int = WINDOW, mb: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, h, start, end, wid): each place where a window stands in a document; (wid, item_id); and the stored index."""
    index, owners, places, found = find(docs, items, width, 0, mb)
    named = found.join(maybe_broadcast(places, mb), "pid").select("doc_id", "h", (F.col("pos") - F.col("offset")).alias("start"), "wid", "window", "n_words")
    named = named.where("start >= 0 AND start + size(window) <= n_words").select("doc_id", "h", "start", "wid", "window").distinct()
    # what the lists agree on is compared with the words themselves: windows go to the documents, whose words stay where they are
    asked = named.groupBy(F.col("doc_id").alias("a_id"), F.col("h").alias("a_h")).agg(F.collect_list(F.struct("start", "wid", "window")).alias("asked"))
    asked = materialize(asked, "bench-asked")
    rows = keyed(docs).join(maybe_broadcast(asked, mb), F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h"))).select("doc_id", "h", words_of(F.col("text")).alias("words"), "asked")
    true = F.filter("asked", lambda a: F.slice(F.col("words"), a["start"] + 1, F.size(a["window"])) == a["window"])
    spans = F.transform(true, lambda a: F.struct(a["start"].alias("start"), (a["start"] + F.size(a["window"])).alias("end"), a["wid"].alias("wid")))
    hits = rows.select("doc_id", "h", F.explode(spans).alias("s")).select("doc_id", "h", "s.*").distinct()
    return materialize(hits, "bench-hits"), owners, index


def near_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, width: int = WINDOW, mb: int = 16) -> DataFrame:
    """Proximity matches (doc_id, item_id, places, off): the items of which the signature terms of some window all stand
    within `slop` words of their places; how many places; and the least distance that they are off, 0 for most exact ones.
    Windows of one term are left out, as are rows without an item_id."""
    _, owners, places, found = find(docs, items, width, slop, mb)
    wide = places.where("size(window) > 1").select("wid", "pid", "offset")
    named = found.join(maybe_broadcast(wide, mb), "pid").join(maybe_broadcast(owners, mb), "wid")
    return named.groupBy("doc_id", "h", "item_id").agg(F.count_distinct(F.col("pos") - F.col("offset")).alias("places"), F.min("off").alias("off")).drop("h")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, mb: int = 16) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (sorted strings)."""
    hits, owners, index = find_windows(docs, items, width, mb)
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("top"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["top"], s["end"]).alias("top"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["top"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    spans = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).agg(F.collect_set(F.struct("start", "end")).alias("spans")).select("hit_id", "hit_h", covered.alias("n_hit"))
    owned = hits.select("doc_id", "h", "wid").distinct().join(maybe_broadcast(owners, mb), "wid").select("doc_id", "h", "item_id").distinct()
    owned = owned.groupBy(F.col("doc_id").alias("own_id"), F.col("h").alias("own_h")).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    rows = index.where("head").select("doc_id", "h", "n_words")
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    out = out.join(owned, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")), "left")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    hits = find_windows(docs, items, width)[0].select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left_anti").select("row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def hits_sql(docs: str = "documents") -> str:
    """DuckDB SQL: per document the words, hit words and items."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({lower.format("text")}, {word}) AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, len(w[i:i+9]) AS l, w[i] AS w0, array_to_string(w[i:i+9], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, {word}) AS w FROM {docs}),
dp AS (SELECT doc_id, w, i FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
hit AS (SELECT dp.doc_id, bw.item_id, dp.i, bw.l FROM dp JOIN bw ON dp.w[dp.i] = bw.w0 AND array_to_string(dp.w[dp.i:dp.i + bw.l - 1], ' ') = bw.k),
pos AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, l)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id),
res AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, '') AS ids
  FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id))
"""


ORACLE = hits_sql() + "SELECT doc_id, n_words, n_hit, n_items, sha256(ids) AS items_sha256, n_hit > 0 AS contaminated FROM res"
