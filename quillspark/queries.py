"""Registered queries of the narration operators: each takes (spark, sf_dir) and returns a DataFrame; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import nfkc as nfkc_fn
from quillspark.functions import patterns as P
from quillspark.functions import text as T
from quillspark.operators import chunking, language, lines, media, metadata, paragraphs, speakers, toc
from quillspark.operators.order import numbered
from quillspark.plans import render, reports
from quillspark.sources.io import manifest, scratch_folder, table
from quillspark.sources.pages import blank_page, decoded_pages, feed_pages, with_second_source, write_pages
from quillspark.streaming import captions, catalog
from quillspark.streaming.resume import pending

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def sql_words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def sql_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


# --- derived inputs, built alike in Spark and SQL ---


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def places(spark: SparkSession, d: str, **columns) -> DataFrame:
    """(source, doc_id, page_idx) of each page, and columns made of its row; texts themselves stay where they are."""
    return numbered(documents(spark, d).select("source", "doc_id", *[c.alias(k) for k, c in columns.items()]), "source", "doc_id", "page_idx")


def book_pages(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d, text=F.col("text")).select("source", "page_idx", "text")


PAGES = "pages_ AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_idx, text FROM documents)"


def first_pages(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The first n pages of each book; tasks pass on no more than n of a book."""
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return documents(spark, d).select("source", "doc_id", "text").withColumn("k", k).where(F.col("k") <= n).select("source", (F.col("k") - 1).alias("page_idx"), "text")


def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth page opens a chapter; some titles and pages occur twice."""
    heads = places(spark, d, head=F.left(F.regexp_extract("text", r"^[^\n]*", 0), F.lit(30))).where("page_idx % 5 = 0")
    base = heads.select("source", "page_idx", F.concat(F.expr("page_idx div 5"), F.lit(" "), "head").alias("title"))
    entry = lambda ord_, title, page: F.struct(F.expr(ord_).alias("ord"), title.alias("title"), F.expr(page).alias("page_idx"))
    again = entry("page_idx * 2 + 1", F.concat("title", F.lit(" ")), "page_idx + 3")
    rear = entry("page_idx * 2 + 1", F.concat(F.lit("Appendix "), "page_idx"), "page_idx + page_idx % 2")
    entries = F.array(entry("page_idx * 2", F.col("title"), "page_idx"), F.when(F.col("page_idx") % 10 == 0, again), F.when(F.col("page_idx") % 15 == 5, rear))
    return base.select("source", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("source", "e.*")


ENTRIES = PAGES + r""",
toc0 AS (SELECT source, page_idx, concat(page_idx // 5, ' ', left(regexp_extract(text, '^[^\n]*', 0), 30)) AS title FROM pages_ WHERE page_idx % 5 = 0),
toc AS (SELECT source, page_idx * 2 AS ord, title, page_idx FROM toc0
  UNION ALL SELECT source, page_idx * 2 + 1, title || ' ', page_idx + 3 FROM toc0 WHERE page_idx % 10 = 0
  UNION ALL SELECT source, page_idx * 2 + 1, concat('Appendix ', page_idx), page_idx + page_idx % 2 FROM toc0 WHERE page_idx % 15 = 5)"""


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, text): `Role: text` per turn, on lines of their own."""
    c = table(spark, d, "conversations")
    line = F.concat(F.upper(F.left("role", F.lit(1))), F.expr("substring(role, 2)"), F.lit(": "), "text")
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("t")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("text"))


SCRIPTS = r"""scripts AS (SELECT conv_id, string_agg(concat(upper(left(role, 1)), substr(role, 2), ': ', text), chr(10) ORDER BY turn) AS text FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id),
script_lines AS (SELECT conv_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM scripts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i))"""


def script_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.explode_lines(scripts(spark, d), "conv_id")


# --- text functions ---


@query("q_norm_words", rf"SELECT doc_id, len({sql_words('text')}) AS n_words, md5({sql_strip(r'''regexp_replace(text, '\s+', ' ', 'g')''')}) AS collapsed FROM documents")
def q_norm_words(spark, d):
    return documents(spark, d).select("doc_id", T.n_words(F.col("text")).alias("n_words"), F.md5(T.collapse(F.col("text"))).alias("collapsed"))


@query("q_prepare_tts", r"""
WITH a AS (SELECT doc_id, replace(replace(replace(translate(text, '“”‘’ ' || chr(9) || chr(10) || chr(13), '""''''    '), '—', ' - '), '–', ' - '), '…', '...') AS t FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[^\x00-\x7F\p{L}]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM a)
SELECT doc_id, length(t) AS n_chars, md5(t) AS prepared FROM b""")
def q_prepare_tts(spark, d):
    t = T.prepare(F.col("text"))
    return documents(spark, d).select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("prepared"))


@query("q_spoken_numbers", r"""
WITH t AS (SELECT o_orderkey, concat('Order of 12,345 in ', CAST(year(o_orderdate) AS VARCHAR), ' weighed ', CAST(o_orderkey % 90 AS VARCHAR), ' kg. Dr. M. Frank saw 5 ft at 7 P.M. in the USA.') AS t FROM orders),
a AS (SELECT o_orderkey, regexp_replace(regexp_replace(t, '(?i)\bP\.M\.?\b', 'P M', 'g'), '\bUSA\b', 'U S A', 'g') AS t FROM t),
b AS (SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(t, '\bDr\.', 'Doctor', 'g'), '\b(\d+)\s*ft\.?\b', '\1 feet', 'g'), '\b(\d+)\s*in\.?\b', '\1 inches', 'g') AS t FROM a),
c AS (SELECT o_orderkey, regexp_replace(t, '\b(\d+)\s*kg\.?\b', '\1 kilograms', 'g') AS t FROM b),
e AS (SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(t, '\b19(\d{2})\b', 'nineteen \1', 'g'), '\b20(\d{2})\b', 'twenty \1', 'g'), '\b(\d{1,3}),(\d{3})\b', '\1 thousand \2', 'g') AS t FROM c)
SELECT o_orderkey, regexp_replace(t, '\b([A-Z])\. ([A-Z][a-z]+)\b', '\1 \2', 'g') AS spoken FROM e""")
def q_spoken_numbers(spark, d):
    t = F.expr("concat('Order of 12,345 in ', cast(year(o_orderdate) as string), ' weighed ', cast(o_orderkey % 90 as string), ' kg. Dr. M. Frank saw 5 ft at 7 P.M. in the USA.')")
    return table(spark, d, "orders").select("o_orderkey", T.spoken(t).alias("spoken"))


@query("q_nfkc")
def q_nfkc(spark, d):
    return documents(spark, d).select("doc_id", F.md5(nfkc_fn.normalize_text(F.col("text"))).alias("normal"))


@query("q_sentences", r"""
SELECT doc_id, len(string_split(regexp_replace(text, '([.?!]) +', '\1' || chr(1), 'g'), chr(1))) AS by_spaces,
       len(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))) AS by_white FROM documents""")
def q_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.sentences_spaces(F.col("text"))).alias("by_spaces"), F.size(T.sentences_any(F.col("text"))).alias("by_white"))


@query("q_roman", r"""
WITH RECURSIVE n AS (SELECT p_partkey, p_size AS v FROM part), r AS (
  SELECT p_partkey, v, v AS rest, '' AS s FROM n
  UNION ALL SELECT p_partkey, v, CASE WHEN rest >= 50 THEN rest - 50 WHEN rest >= 40 THEN rest - 40 WHEN rest >= 10 THEN rest - 10 WHEN rest >= 9 THEN rest - 9 WHEN rest >= 5 THEN rest - 5 WHEN rest >= 4 THEN rest - 4 ELSE rest - 1 END,
    s || CASE WHEN rest >= 50 THEN 'l' WHEN rest >= 40 THEN 'xl' WHEN rest >= 10 THEN 'x' WHEN rest >= 9 THEN 'ix' WHEN rest >= 5 THEN 'v' WHEN rest >= 4 THEN 'iv' ELSE 'i' END FROM r WHERE rest > 0)
SELECT p_partkey, s AS numeral, v AS value FROM r WHERE rest = 0 AND v > 0""")
def q_roman(spark, d):
    digit = lambda n, a, b, c: F.element_at(F.array(*[F.lit(x) for x in ("", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c)]), (n + 1).cast("int"))
    size = F.col("p_size")
    numeral = F.concat(digit(F.floor(size / 10), "x", "l", "c"), digit(size % 10, "i", "v", "x"))
    return table(spark, d, "part").select("p_partkey", numeral.alias("numeral")).select("p_partkey", "numeral", T.roman(F.col("numeral")).alias("value")).where("value > 0")


@query("q_names", r"""
SELECT p_partkey, concat('chapter_', lpad(CAST(p_size AS VARCHAR), 2, '0'), '_', left(regexp_replace(regexp_replace(p_name || ': ' || p_type, '[^a-zA-Z0-9_\-\s]', '', 'g'), '\s+', '_', 'g'), 50), '.txt') AS file_name,
  'speaker_' || replace(lower(p_brand), ' ', '_') AS slug,
  CASE WHEN length(p_type || repeat(p_name, 12)) > 200 THEN left(p_type || repeat(p_name, 12), 200) || '...' ELSE p_type || repeat(p_name, 12) END AS snippet FROM part""")
def q_names(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", T.file_name(F.col("p_size"), F.concat("p_name", F.lit(": "), "p_type")).alias("file_name"), T.voice_slug(F.col("p_brand")).alias("slug"),
        T.snippet(F.concat("p_type", F.repeat("p_name", 12))).alias("snippet"),
    )


@query("q_video_ids", r"""
SELECT page_id, coalesce(nullif(regexp_extract(u, '(?:youtube\.com/watch\?v=|youtu\.be/)([^&\n?#]+)', 1), ''), nullif(regexp_extract(u, 'youtube\.com/embed/([^&\n?#]+)', 1), '')) AS video_id
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://youtu.be/v' || page_id || '?t=3' WHEN 1 THEN 'https://www.youtube.com/embed/e' || page_id || '#x' ELSE url END AS u FROM pages)""")
def q_video_ids(spark, d):
    u = F.expr("CASE page_id % 3 WHEN 0 THEN concat('https://youtu.be/v', page_id, '?t=3') WHEN 1 THEN concat('https://www.youtube.com/embed/e', page_id, '#x') ELSE url END")
    return table(spark, d, "pages").select("page_id", T.video_id(u).alias("video_id"))


# --- lines ---


@query("q_page_quality", rf"SELECT doc_id, coalesce(length({sql_strip('text')}), 0) < 100 AS low, coalesce(length({sql_strip('text')}), 0) = 0 AS blank FROM documents")
def q_page_quality(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", lines.low_quality(t).alias("low"), lines.low_quality(t, 1).alias("blank"))


LINES = rf"""
dl AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)),
s AS (SELECT *, {sql_strip('line')} AS stripped FROM dl),
m AS (SELECT *, length(stripped) AS n, count(*) OVER (PARTITION BY doc_id, stripped) AS times, min(line_no) OVER (PARTITION BY doc_id, line) AS first_no,
        max(line_no) OVER (PARTITION BY doc_id) AS last_no, regexp_matches(stripped, '(?i)^(?:{"|".join(P.MARGINALIA)})$') AS marg FROM s),
f AS (SELECT *, CASE WHEN n = 0 THEN 'blank' WHEN marg THEN 'marginalia' WHEN times >= 2 AND n > 10 AND n < 100 THEN 'repeated'
        WHEN n > 5 AND len(regexp_extract_all(stripped, '\p{{L}}')) / n < 0.3 THEN 'symbols' WHEN (first_no < 3 OR first_no >= last_no - 2) AND n < 5 THEN 'edge' ELSE 'keep' END AS fate FROM m)"""


@query("q_line_fates", f"WITH {LINES} SELECT fate, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM f GROUP BY fate")
def q_line_fates(spark, d):
    return lines.judge_lines(lines.explode_lines(documents(spark, d))).groupBy("fate").agg(F.count("*").alias("n"), F.sum(F.length("stripped")).alias("chars"))


@query("q_line_clean", rf"""WITH {LINES}
SELECT doc_id, md5(string_agg(CASE WHEN fate = 'blank' THEN '' ELSE repeat(' ', least(length(line) - length(regexp_replace(line, '^\s+', '')), 8)) || stripped END, chr(10) ORDER BY line_no)) AS cleaned
FROM f WHERE fate IN ('blank', 'keep') GROUP BY doc_id""")
def q_line_clean(spark, d):
    return lines.clean_pages(lines.explode_lines(documents(spark, d))).select("doc_id", F.md5("text").alias("cleaned"))


# --- chunking ---

CHUNKS = r"""
cs AS (SELECT doc_id, string_split(regexp_replace(text, '([.?!]) +', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE trim(text) <> ''),
cf(doc_id, i, cur, emitted) AS (
  SELECT doc_id, 0, '', NULL::VARCHAR FROM cs
  UNION ALL
  SELECT cf.doc_id, i + 1,
    CASE WHEN i + 1 > len(s) THEN '' WHEN length(cur) + length(s[i + 1]) <= 250 THEN cur || s[i + 1] || ' ' ELSE s[i + 1] || ' ' END,
    CASE WHEN i + 1 > len(s) OR length(cur) + length(s[i + 1]) > 250 THEN regexp_replace(regexp_replace(cur, '^\s+', ''), '\s+$', '') END
  FROM cf JOIN cs USING (doc_id) WHERE i <= len(s)),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, emitted AS chunk FROM cf WHERE length(emitted) >= 20)"""


@query("q_chunk_v1", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no, length(chunk) AS n_chars, md5(chunk) AS chunk FROM chunks")
def q_chunk_v1(spark, d):
    c = documents(spark, d).select("doc_id", F.posexplode(chunking.pack_trailing(F.col("text"), 250, 20)).alias("chunk_no", "c"))
    return c.select("doc_id", "chunk_no", F.length("c").alias("n_chars"), F.md5("c").alias("chunk"))


def _chunks(pack):
    def run(spark, d):
        c = documents(spark, d).select("doc_id", F.posexplode(pack(F.col("text"))).alias("chunk_no", "chunk"))
        return c.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk"))

    return run


query("q_chunk_v2")(_chunks(lambda t: chunking.pack_clauses(t, 250, 30)))
query("q_chunk_v3")(_chunks(lambda t: chunking.pack_wrapped(t, 220)))
query("q_chunk_v4")(_chunks(lambda t: chunking.pack_cut(t, 200)))
query("q_chunk_v5")(_chunks(lambda t: chunking.pack_paragraphs(t, 5000, 30)))


@query("q_chunk_validate", rf"""WITH RECURSIVE {CHUNKS},
g AS (SELECT doc_id, string_agg(chunk, ' ' ORDER BY chunk_no) AS t, count(*) FILTER (length(chunk) < 20) AS tiny FROM chunks GROUP BY doc_id),
v AS (SELECT d.doc_id, len({sql_words('d.text')}) - coalesce(len({sql_words('g.t')}), 0) AS missing, coalesce(tiny, 0) AS tiny FROM documents d LEFT JOIN g USING (doc_id))
SELECT doc_id, missing = 0 AND tiny = 0 AS ok, missing, tiny FROM v""")
def q_chunk_validate(spark, d):
    chunks = chunking.pack_trailing(F.col("text"), 250, 20)
    return documents(spark, d).select("doc_id", chunking.chunk_check(F.col("text"), chunks).alias("v")).select("doc_id", "v.*")


# --- contents and chapters ---


@query("q_toc_parse", rf"""
WITH x AS (SELECT doc_id, translate(concat(left(regexp_extract(text, '^[^\n]*', 0), 30), ' ..... ', doc_id % 300), '–—‒', '---') AS l FROM documents)
SELECT doc_id, regexp_replace({sql_strip(r'''regexp_extract(l, '^\s*(.+?)[.\-\s]{2,}(\S+)\s*$', 1)''')}, '[.\-\s–—_]+$', '') AS title, regexp_extract(l, '^\s*(.+?)[.\-\s]{{2,}}(\S+)\s*$', 2) AS page
FROM x WHERE regexp_matches(l, '^\s*(.+?)[.\-\s]{{2,}}(\S+)\s*$')""")
def q_toc_parse(spark, d):
    line = F.concat(F.left(F.regexp_extract("text", r"^[^\n]*", 0), F.lit(30)), F.lit(" ..... "), F.expr("doc_id % 300"))
    return documents(spark, d).select("doc_id", T.toc_line(line).alias("t")).where("t IS NOT NULL").select("doc_id", "t.*")


@query("q_toc_union", f"""WITH {ENTRIES},
b AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END AS rank FROM toc UNION ALL SELECT source, ord + 1000, title, page_idx, 0 FROM toc WHERE ord % 4 = 0)
SELECT source, coalesce(arg_max(title, ord) FILTER (rank = 0), arg_min(title, ord) FILTER (rank = 1)) AS title, page_idx, min(rank) AS origin,
  coalesce(min(ord) FILTER (rank = 0), min(ord)) AS ord FROM b GROUP BY source, lower(title), page_idx""")
def q_toc_union(spark, d):
    e = toc_entries(spark, d)
    marks = e.where("ord % 3 = 0").unionByName(e.where("ord % 4 = 0").withColumn("ord", F.col("ord") + 1000))
    return toc.unite(marks, e.where("ord % 3 <> 0"))


DEDUP = ENTRIES + r""",
te AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord, title, page_idx) AS rn, ord, title, page_idx, lower(trim(title)) AS low, nullif(regexp_extract(trim(title), '^\s*(\d+(?:\.\d+)?)', 1), '') AS num FROM toc),
tf(source, rn, titles, nums, kept) AS (
  SELECT DISTINCT source, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], FALSE FROM te
  UNION ALL
  SELECT te.source, te.rn,
    CASE WHEN list_contains(titles, low) OR (num IS NOT NULL AND list_contains(nums, num)) THEN titles ELSE list_append(titles, low) END,
    CASE WHEN list_contains(titles, low) OR num IS NULL OR list_contains(nums, num) THEN nums ELSE list_append(nums, num) END,
    NOT (list_contains(titles, low) OR (num IS NOT NULL AND list_contains(nums, num)))
  FROM tf JOIN te ON te.source = tf.source AND te.rn = tf.rn + 1),
clean AS (SELECT te.source, ord, title, page_idx FROM tf JOIN te USING (source, rn) WHERE kept QUALIFY row_number() OVER (PARTITION BY te.source, page_idx ORDER BY ord) = 1)"""


@query("q_toc_dedup", f"WITH RECURSIVE {DEDUP} SELECT * FROM clean")
def q_toc_dedup(spark, d):
    return toc.deduplicate(toc_entries(spark, d))


SECTIONS = DEDUP + rf""",
pl AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_idx, ord) AS place FROM clean),
sec AS (SELECT *, CASE WHEN place < min(place) FILTER (regexp_matches(lower(title), '^(?:chapter\s*)?1[.\s:-]')) OVER (PARTITION BY source) THEN 'front'
  WHEN {" OR ".join(f"contains(lower(title), '{k}')" for k in P.REAR_MATTER)} THEN 'rear' ELSE 'main' END AS section FROM pl)"""


@query("q_sections", f"WITH RECURSIVE {SECTIONS} SELECT source, ord, title, page_idx, section FROM sec")
def q_sections(spark, d):
    return toc.sections(toc.deduplicate(toc_entries(spark, d)))


RANGES = SECTIONS + """,
tot AS (SELECT source, count(*) AS n_pages FROM pages_ GROUP BY source),
rr AS (SELECT sec.*, min(page_idx) FILTER (section = 'rear') OVER (PARTITION BY source) AS rear_page FROM sec),
ranges AS (SELECT rr.source, row_number() OVER w AS chapter_no, title, page_idx AS start_page, CAST(coalesce(lead(page_idx) OVER w, rear_page, n_pages) AS INTEGER) AS end_page
  FROM rr JOIN tot USING (source) WHERE section = 'main' WINDOW w AS (PARTITION BY rr.source ORDER BY page_idx, ord))"""


@query("q_chapter_ranges", f"WITH RECURSIVE {RANGES} SELECT * FROM ranges")
def q_chapter_ranges(spark, d):
    return toc.chapter_ranges(toc.deduplicate(toc_entries(spark, d)), documents(spark, d))


@query("q_chapter_pages", f"""WITH RECURSIVE {RANGES}
SELECT r.source, chapter_no, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM ranges r JOIN pages_ p ON p.source = r.source AND p.page_idx >= start_page AND p.page_idx < end_page GROUP BY r.source, chapter_no""")
def q_chapter_pages(spark, d):
    ranges = toc.chapter_ranges(toc.deduplicate(toc_entries(spark, d)), documents(spark, d))
    joined = toc.chapter_pages(ranges, places(spark, d, n=F.length("text")))
    return joined.groupBy("source", "chapter_no").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))


@query("q_missing_chapters", f"""WITH {ENTRIES},
n AS (SELECT DISTINCT source, CAST(regexp_extract(title, '^\\s*(\\d+)', 1) AS INTEGER) AS n FROM toc WHERE regexp_matches(title, '^\\s*\\d+') AND ord % 4 = 0)
SELECT source, CAST(i AS INTEGER) AS missing FROM (SELECT source, min(n) AS a, max(n) AS b FROM n GROUP BY source), unnest(range(a, b)) AS t(i)
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = source AND FALSE) AND (source, i) NOT IN (SELECT (source, n) FROM n)""")
def q_missing_chapters(spark, d):
    return toc.missing_chapters(toc_entries(spark, d).where("ord % 4 = 0"))


LABELS = PAGES + """,
labels_ AS (SELECT source, CASE WHEN page_idx < 3 THEN ['i', 'ii', 'iii'][page_idx + 1] ELSE CAST(page_idx * 2 - 5 AS VARCHAR) END AS label, page_idx, page_idx AS ord FROM pages_),
qs AS (SELECT DISTINCT source, q AS query FROM pages_, unnest(['2', '3', '10', '900', 'II', 'vii', 'x9']) AS t(q))"""


@query("q_page_lookup", f"""WITH {LABELS},
v AS (SELECT *, CASE WHEN regexp_matches(label, '^\\d+$') THEN CAST(label AS INTEGER) WHEN label = 'i' THEN 1 WHEN label = 'ii' THEN 2 WHEN label = 'iii' THEN 3 END AS v FROM labels_),
r AS (SELECT *, CASE query WHEN 'II' THEN 2 WHEN 'vii' THEN 7 END AS r, CASE WHEN regexp_matches(query, '^\\d+$') THEN CAST(query AS INTEGER) END AS n FROM qs)
SELECT source, query, coalesce(
  (SELECT min(page_idx) FROM labels_ l WHERE l.source = r.source AND l.label = lower(query)),
  (SELECT min(page_idx) FROM v WHERE v.source = r.source AND regexp_matches(v.label, '^\\d+$') AND v.v >= r.n),
  (SELECT arg_min(page_idx, ord) FROM v WHERE v.source = r.source AND v.v = r.r)) AS page_idx FROM r""")
def q_page_lookup(spark, d):
    pages = places(spark, d)
    label = F.when(F.col("page_idx") < 3, F.element_at(F.array(F.lit("i"), F.lit("ii"), F.lit("iii")), F.least(F.col("page_idx"), F.lit(2)) + 1)).otherwise((F.col("page_idx") * 2 - 5).cast("string"))
    labels = pages.select("source", label.alias("label"), "page_idx", F.col("page_idx").alias("ord"))
    asked = documents(spark, d).select("source").distinct().withColumn("query", F.explode(F.array(*[F.lit(x) for x in ("2", "3", "10", "900", "II", "vii", "x9")])))
    return toc.look_up_pages(labels, asked)


@query("q_footer_labels", rf"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(concat(text, chr(10), CASE doc_id % 4 WHEN 0 THEN 'Page ' || doc_id WHEN 1 THEN 'xiv.' WHEN 2 THEN doc_id || chr(10) || 'end' ELSE 'none here' END), chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM documents),
h AS (SELECT doc_id, list_filter(list_transform(l[-2:], lambda x: regexp_extract(replace(lower(x), '.', ''), '^(?:page\s*)?([ivxlcdm\d]+)$', 1)), lambda x: x <> '') AS h FROM p)
SELECT doc_id, h[1] AS label FROM h""")
def q_footer_labels(spark, d):
    tail = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('Page ', doc_id) WHEN 1 THEN 'xiv.' WHEN 2 THEN concat(doc_id, '\n', 'end') ELSE 'none here' END")
    kept = F.filter(F.transform(T.lines(F.concat("text", F.lit("\n"), tail)), T.strip), lambda x: x != "")
    return documents(spark, d).select("doc_id", T.footer_label(kept).alias("label"))


# --- language and metadata ---

LANGS = " UNION ALL ".join(
    f"SELECT doc_id, len(w) AS total, '{lang}' AS lang, len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))) AS hits FROM w" for lang, ws in P.LANG_MARKERS
)
SHARES = rf"""w AS (SELECT doc_id, list_transform({sql_words('lower(text)')}, lambda x: regexp_replace(regexp_replace(x, '^[[:punct:]]+', ''), '[[:punct:]]+$', '')) AS w FROM documents),
sh AS (SELECT *, CASE WHEN total > 0 THEN hits / total ELSE 0.0 END AS share FROM ({LANGS}))"""


@query("q_lang_profile", f"WITH {SHARES} SELECT * FROM sh")
def q_lang_profile(spark, d):
    return language.marker_shares(documents(spark, d))


@query("q_lang_top", f"WITH {SHARES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, lang) AS rank, lang, share FROM sh QUALIFY rank <= 5 AND share > 0.005")
def q_lang_top(spark, d):
    return language.top_languages(language.marker_shares(documents(spark, d)))


TITLE_TRIES = " UNION ALL ".join(
    f"SELECT source, page_idx, 0 AS p, -1 AS i, {k} AS k, j, {sql_strip('m[j]')} AS title FROM (SELECT source, page_idx, regexp_extract_all(t, '{rx}', 1) AS m FROM tp), unnest(range(1, len(m) + 1)) AS u(j)" for k, rx in enumerate(P.TITLE_PATTERNS)
)


@query("q_title", rf"""WITH {PAGES},
tl AS (SELECT source, page_idx, list_filter(list_transform(string_split(text, chr(10)), lambda y: {sql_strip('y')}), lambda y: y <> '') AS x FROM pages_ WHERE page_idx < 5),
tp AS (SELECT source, page_idx, array_to_string(x, ' ') AS t FROM tl WHERE len(x) > 0),
pt AS (SELECT * FROM ({TITLE_TRIES}) WHERE length(title) >= 5 AND NOT regexp_matches(title, '^\d') AND NOT contains(lower(title), 'chapter') AND NOT contains(lower(title), 'page') AND NOT starts_with(lower(title), 'by')),
ll AS (SELECT source, page_idx, i - 1 AS i, x[i] AS line FROM tl, unnest(range(1, least(len(x), 15) + 1)) AS u(i)),
lp AS (SELECT source, page_idx, i, line, 10 - i + CASE WHEN contains(lower(line), 'story') THEN 10 ELSE 0 END + CASE WHEN contains(lower(line), 'memoir') THEN 8 ELSE 0 END
    + CASE WHEN (upper(line) = line AND regexp_matches(line, '\p{{Lu}}')) OR regexp_matches(line, '^\P{{L}}*\p{{Lu}}\p{{Ll}}*(?:\P{{L}}+\p{{Lu}}\p{{Ll}}*)*\P{{L}}*$') THEN 5 ELSE 0 END AS p
  FROM ll WHERE length(line) BETWEEN 10 AND 80 AND NOT regexp_matches(lower(line), '^(page|chapter|\d+|©|copyright|isbn|by\s+)')
    AND len(regexp_extract_all(line, '[^a-zA-Z\s]')) <= length(line) * 0.4::DOUBLE AND len(regexp_extract_all(line, '\d')) <= length(line) * 0.2::DOUBLE
    AND regexp_matches(line, '(?:^|\s)\p{{Lu}}') AND NOT ends_with(line, '.') AND length(line) - length(replace(line, ' ', '')) BETWEEN 1 AND 8),
tall AS (SELECT source, page_idx, -p AS p, i, 0 AS k, 0 AS j, line FROM lp UNION ALL SELECT source, page_idx, p, i, k, j, title FROM pt)
SELECT source, first(line ORDER BY p, page_idx, i, k, j) AS title FROM tall GROUP BY source""")
def q_title(spark, d):
    return metadata.titles(first_pages(spark, d, 5))


@query("q_author", rf"""WITH {PAGES},
l AS (SELECT source, page_idx, i, x[i] AS line FROM (SELECT source, page_idx, list_filter(list_transform(string_split(text, chr(10)), lambda y: {sql_strip('y')}), lambda y: y <> '')[1:15] AS x FROM pages_ WHERE page_idx < 3), unnest(range(1, len(x) + 1)) AS t(i)),
a AS (SELECT source, page_idx, i, list_filter([{sql_strip("regexp_extract(line, '(?i)by\\s+([a-zA-Z\\s.]+)', 1)")}, {sql_strip("regexp_extract(line, '(?i)author[:\\s]+([a-zA-Z\\s.]+)', 1)")},
  {sql_strip("regexp_extract(line, '(?i)^([A-Z][a-z]+\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)$', 1)")}], lambda y: length(y) BETWEEN 5 AND 50)[1] AS author FROM l),
g AS (SELECT source, arg_min(author, page_idx * 100 + i) AS author FROM a WHERE author IS NOT NULL GROUP BY source)
SELECT source, coalesce(author, 'Unknown Author') AS author FROM (SELECT DISTINCT source FROM pages_) LEFT JOIN g USING (source)""")
def q_author(spark, d):
    return metadata.authors(first_pages(spark, d, 3))


# --- speakers ---

VERBS = "|".join(P.ATTRIBUTION_VERBS)
NAME = speakers.NAME
BAD = ", ".join(f"'{x}'" for x in P.NOT_SPEAKERS)


def _found_sql() -> str:
    parts = []
    for i, (rx, who, what) in enumerate(speakers.line_patterns(P.ATTRIBUTION_VERBS)):
        parts.append(f"SELECT conv_id, line_no, {i} AS k, unnest(regexp_extract_all({sql_strip('line')}, '{rx}', {who})) AS speaker, unnest(regexp_extract_all({sql_strip('line')}, '{rx}', {what})) AS words FROM script_lines")
    ok = rf"length(speaker) BETWEEN 2 AND 50 AND lower(speaker) NOT IN ({BAD}) AND regexp_matches(speaker, '\p{{L}}') AND len({sql_words('speaker')}) <= 3"
    return SCRIPTS + f""",
found AS (SELECT conv_id, line_no, k, {sql_strip('speaker')} AS speaker, {sql_strip('words')} AS words FROM ({" UNION ALL ".join(parts)}) WHERE {ok}),
counts AS (SELECT conv_id, speaker, count(*) AS dialogues, CAST(sum(len({sql_words('words')})) AS BIGINT) AS n_words, min(line_no * 10 + k) AS first_at FROM found GROUP BY conv_id, speaker HAVING count(*) >= 2)"""


FOUND = _found_sql()


def _found(spark, d):
    return speakers.utterances(script_lines(spark, d), "conv_id")


@query("q_speakers", f"WITH {FOUND} SELECT conv_id, speaker, dialogues, n_words FROM counts")
def q_speakers(spark, d):
    return speakers.speaker_counts(_found(spark, d), "conv_id").drop("first")


@query("q_speaker_merge", f"WITH {FOUND} SELECT speaker, CAST(sum(dialogues) AS BIGINT) AS dialogues, CAST(sum(n_words) AS BIGINT) AS n_words, min(conv_id) AS first_chapter, count(*) AS chapters FROM counts GROUP BY speaker")
def q_speaker_merge(spark, d):
    return speakers.merge_speakers(speakers.speaker_counts(_found(spark, d), "conv_id"), "conv_id")


def _count_sql(ws: list[str], more: str = "") -> str:
    return rf"len(regexp_extract_all(t, '(?i){more}\b(?:{'|'.join(ws)})\b'))"


@query("q_speaker_traits", rf"""WITH {FOUND},
j AS (SELECT conv_id, speaker, string_agg(words, ' ' ORDER BY line_no, k) AS t FROM found GROUP BY conv_id, speaker),
c AS (SELECT conv_id, speaker, t, {_count_sql(P.FORMAL)} AS f, {_count_sql(P.CASUAL)} AS c, {_count_sql(P.EXCITED, '[!]+|[?!]+|')} AS e, {_count_sql(P.CALM)} AS m, greatest(len(string_split_regex(t, '[.!?]+')), 1) AS n FROM j)
SELECT conv_id, speaker, f / greatest(f + c, 1) AS formality, e / n AS excitement, m / n AS calmness, list_sum(list_transform(string_split_regex(t, '[.!?]+'), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')))) / n AS sentence_words FROM c""")
def q_speaker_traits(spark, d):
    return speakers.traits(_found(spark, d), "conv_id").drop("snippets")


def _segments_sql() -> str:
    who, what = "NULL", "NULL"
    for rx, a, b in reversed(speakers.line_patterns(P.SEGMENT_VERBS)):
        hit = f"regexp_matches(l, '{rx}')"
        who, what = f"CASE WHEN {hit} THEN regexp_extract(l, '{rx}', {a}) ELSE {who} END", f"CASE WHEN {hit} THEN regexp_extract(l, '{rx}', {b}) ELSE {what} END"
    return SCRIPTS + rf""",
sl AS (SELECT conv_id, line_no, {sql_strip('line')} AS l FROM script_lines),
sw AS (SELECT *, {sql_strip(who)} AS who, {sql_strip(what)} AS what FROM sl),
sv AS (SELECT *, coalesce(length(who) BETWEEN 2 AND 50 AND lower(who) NOT IN ({BAD}) AND len({sql_words('who')}) <= 3, FALSE) AS spoken FROM sw),
so AS (SELECT *, CAST(who IS NOT NULL AS INTEGER) + coalesce(lag(CAST(spoken AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY line_no), 0) AS brk FROM sv),
si AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY line_no) AS island FROM so),
sg AS (SELECT conv_id, min(line_no) AS at_, CASE WHEN spoken THEN max(who) ELSE 'narrator' END AS speaker, CASE WHEN spoken THEN max(what) ELSE {sql_strip("string_agg(l, chr(10) ORDER BY line_no)")} END AS text FROM si GROUP BY conv_id, island, spoken)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY at_) AS seg_no, speaker, md5(text) AS text FROM sg WHERE text <> ''"""


@query("q_segments", "WITH " + _segments_sql())
def q_segments(spark, d):
    return speakers.segments(script_lines(spark, d), "conv_id").withColumn("text", F.md5("text"))


def _voices(spark):
    return spark.createDataFrame([(i, v) for i, (v, _) in enumerate(P.VOICES)], "voice_ord int, voice_id string")


@query("q_voice_roundrobin", f"""WITH {FOUND},
r AS (SELECT conv_id, speaker, (row_number() OVER (PARTITION BY conv_id ORDER BY dialogues DESC, first_at) - 1) % {len(P.VOICES)} AS i FROM counts)
SELECT conv_id, speaker, [{", ".join(repr(v) for v, _ in P.VOICES)}][i + 1] AS voice_id FROM r""")
def q_voice_roundrobin(spark, d):
    return speakers.round_robin(speakers.speaker_counts(_found(spark, d), "conv_id"), _voices(spark), "conv_id").select("conv_id", "speaker", "voice_id")


@query("q_voice_greedy")
def q_voice_greedy(spark, d):
    found = _found(spark, d)
    ranked = speakers.speaker_counts(found, "conv_id").join(speakers.traits(found, "conv_id"), ["conv_id", "speaker"])
    return speakers.greedy_voices(ranked, "conv_id")


@query("q_voice_fuzzy", """
WITH q AS (SELECT DISTINCT query FROM (SELECT r_name AS query FROM region UNION ALL SELECT left(n_name, 4) FROM nation UNION ALL SELECT lower(n_name) || ' voice' FROM nation))
SELECT query, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE contains(lower(query), lower(n_name)) OR contains(lower(n_name), lower(query))) AS name FROM q""")
def q_voice_fuzzy(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    asked = r.select(F.col("r_name").alias("query")).union(n.select(F.left("n_name", F.lit(4)))).union(n.select(F.concat(F.lower("n_name"), F.lit(" voice")))).distinct()
    return render.fuzzy_voice(asked, n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name")))


# --- plans ---

CAPTION_GAP = 20_000.0


@query("q_captions", f"""
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, epoch(ts) AS start, event_type AS text FROM events),
p AS (SELECT *, start - lag(start, 1, 0) OVER (PARTITION BY user_id ORDER BY ord) AS pause FROM c WHERE trim(text) <> ''),
s AS (SELECT *, sum(CASE WHEN pause > {CAPTION_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS turns FROM p)
SELECT user_id, 'Speaker ' || CAST(CAST(turns % 2 + 1 AS INTEGER) AS VARCHAR) AS speaker, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS n_words, count(*) AS captions
FROM s GROUP BY ALL HAVING n_words > 1""")
def q_captions(spark, d):
    e = table(spark, d, "events")
    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    c = e.select("user_id", ord_.alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), F.lit(0.0).alias("duration"), F.col("event_type").alias("text"))
    return render.caption_speakers(c, CAPTION_GAP, 1, "user_id")


@query("q_clip_fill", """
WITH c AS (SELECT conv_id, turn AS clip_no, length(text) * 0.08::DOUBLE AS duration_s FROM conversations),
r AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(duration_s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS laid FROM c WHERE duration_s BETWEEN 2 AND 10 WINDOW w AS (PARTITION BY conv_id ORDER BY duration_s DESC, clip_no))
SELECT conv_id, count(*) AS clips, sum(length_) AS chars FROM (SELECT conv_id, laid + (rank - 1) * 0.2::DOUBLE AS start_s, CAST(round(duration_s / 0.08) AS BIGINT) AS length_ FROM r) WHERE start_s < 60 GROUP BY conv_id""")
def q_clip_fill(spark, d):
    clips = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("clip_no"), (F.length("text") * 0.08).alias("duration_s"))
    return render.fill_sample(clips).groupBy("conv_id").agg(F.count("*").alias("clips"), F.sum(F.round(F.col("duration_s") / 0.08).cast("long")).alias("chars"))


@query("q_image_slices", """
WITH n AS (SELECT count(*) AS n FROM part), c AS (SELECT n_nationkey + 1 AS chapter_no FROM nation), k AS (SELECT count(*) AS k FROM c),
r AS (SELECT chapter_no, chapter_no * (n // k) AS lo, CASE WHEN chapter_no = k THEN n ELSE (chapter_no + 1) * (n // k) END AS hi FROM c, n, k)
SELECT chapter_no, count(*) AS images, min(p_partkey) AS first_image FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) JOIN r ON i >= lo AND i < hi GROUP BY chapter_no""")
def q_image_slices(spark, d):
    images = render.global_index(table(spark, d, "part").select("p_partkey"), "p_partkey", "img_idx")
    chapters = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("chapter_no"))
    return render.slice_images(images, chapters).groupBy("chapter_no").agg(F.count("*").alias("images"), F.min("p_partkey").alias("first_image"))


@query("q_image_filter", """
WITH i AS (SELECT p_brand AS doc, p_partkey % 9 AS page_idx, p_size * 20 AS width, CAST(floor(p_retailprice / 4) AS INTEGER) AS height, CASE p_partkey % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' ELSE 'svg' END AS ext, p_partkey % 400 AS text_chars, p_partkey FROM part WHERE p_size > 0),
a AS (SELECT doc, avg(width) AS pw, avg(height) AS ph FROM i WHERE page_idx < 5 GROUP BY doc)
SELECT p_partkey, width, height FROM i LEFT JOIN a USING (doc) WHERE least(width, height) >= 100 AND NOT (width > 0.85 * coalesce(pw, 600) AND height > 0.85 * coalesce(ph, 600)) AND greatest(width, height) / least(width, height) <= 25 AND lower(ext) IN ('png', 'jpg', 'jpeg') AND text_chars < 200""")
def q_image_filter(spark, d):
    i = table(spark, d, "part").where("p_size > 0").selectExpr("p_brand AS doc", "p_partkey % 9 AS page_idx", "p_size * 20 AS width", "cast(floor(p_retailprice / 4) as int) AS height", "CASE p_partkey % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' ELSE 'svg' END AS ext", "p_partkey % 400 AS text_chars", "p_partkey")
    return render.kept_images(i).select("p_partkey", "width", "height")


@query("q_resume", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_resume(spark, d):
    return pending(documents(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars")


@query("q_render_plan", rf"""WITH RECURSIVE {CHUNKS},
e AS (SELECT doc_id, chunk_no, [{", ".join(repr(v) for v, _ in P.VOICES)}][chunk_no % {len(P.VOICES)} + 1] AS voice_id, length(chunk) AS n_chars, CAST(floor(greatest(1.0, length(chunk) * 0.08::DOUBLE) * 1000) AS BIGINT) AS est_ms FROM chunks),
s AS (SELECT *, 500 + coalesce(sum(est_ms + 300) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms FROM e)
SELECT *, start_ms + est_ms AS end_ms FROM s""")
def q_render_plan(spark, d):
    return render.render_plan(documents(spark, d), [v for v, _ in P.VOICES])


@query("q_presets", """SELECT 'style' || p_size AS style, least(1.0::DOUBLE, t * 1.15::DOUBLE) AS temperature, CAST(floor(k * 1.1::DOUBLE) AS INTEGER) AS top_k, s * 1.05::DOUBLE AS speed
FROM (SELECT DISTINCT p_size, p_size * 0.02::DOUBLE AS t, p_size + 20 AS k, 0.8::DOUBLE + p_size * 0.01::DOUBLE AS s FROM part)""")
def q_presets(spark, d):
    p = table(spark, d, "part").select("p_size").distinct().selectExpr("concat('style', p_size) AS style", "p_size * 0.02D AS temperature", "p_size + 20 AS top_k", "0.8D + p_size * 0.01D AS speed")
    return render.scaled_presets(p, 1.5)


@query("q_totals", "SELECT source, count(*) AS chapters, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def q_totals(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("chapters"), F.sum(F.length("text")).alias("chars"), F.count_distinct("lang").alias("langs"))


@query("q_paragraphs")
def q_paragraphs(spark, d):
    return paragraphs.rebuild_paragraphs(documents(spark, d)).select("doc_id", F.md5("text").alias("text"))


# --- clips, images and voices ---


@query("q_clip_quality", """
WITH c AS (SELECT conv_id, turn AS clip_no, length(text) * 0.08::DOUBLE AS duration_s, CAST(length(text) % 17 AS DOUBLE) AS deviation FROM conversations),
s AS (SELECT *, (greatest(0, 1 - abs(duration_s - 12) / 12) + 1 / (1 + deviation / 10)) / 2 AS score FROM c)
SELECT conv_id, arg_max(clip_no, duration_s * 100000 - clip_no) AS longest, first(clip_no ORDER BY score DESC, clip_no) AS best, max(score) AS score, least(count(*) / 10.0::DOUBLE, 1) AS quality,
  CASE WHEN sum(duration_s) >= 45 THEN 'excellent' WHEN sum(duration_s) >= 30 THEN 'good' ELSE 'short' END AS tier,
  CASE WHEN max(duration_s) > 0 THEN greatest(0, least(1, 1 - abs(min(duration_s) - max(duration_s) * 0.8::DOUBLE) / (max(duration_s) * 0.8::DOUBLE))) * 0.3::DOUBLE + (1 - least(max(deviation) / 20, 1)) * 0.3::DOUBLE + 0.7::DOUBLE * 0.4::DOUBLE ELSE 0.5 END AS clone
FROM s GROUP BY conv_id""")
def q_clip_quality(spark, d):
    clips = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("clip_no"), (F.length("text") * 0.08).alias("duration_s"), (F.length("text") % 17).cast("double").alias("deviation"))
    whole = clips.groupBy("conv_id").agg(
        F.max_by("clip_no", F.struct("duration_s", -F.col("clip_no"))).alias("longest"), media.profile_quality(F.count("*")).alias("quality"), media.length_tier(F.sum("duration_s")).alias("tier"),
        media.clone_quality(F.min("duration_s"), F.max("duration_s"), F.max("deviation")).alias("clone"),
    )
    return whole.join(render.best_clips(clips).withColumnRenamed("clip_no", "best"), "conv_id")


@query("q_clip_trim", """
WITH c AS (SELECT conv_id, turn AS clip_no, length(text) * 0.08::DOUBLE AS duration_s FROM conversations WHERE length(text) * 0.08::DOUBLE >= 3)
SELECT conv_id, clip_no, least(duration_s, 30) AS duration_s FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY clip_no) <= 3""")
def q_clip_trim(spark, d):
    clips = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("clip_no"), (F.length("text") * 0.08).alias("duration_s"))
    return media.trimmed_clips(clips, "conv_id", 3)


@query("q_clip_repeat")
def q_clip_repeat(spark, d):
    clips = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("clip_no"), (F.length("text") * 0.08).alias("duration_s"))
    return media.repeated_sample(render.fill_sample(clips))


@query("q_image_fit", """
WITH i AS (SELECT p_partkey, p_size * 20 AS width, CAST(floor(p_retailprice / 4) AS INTEGER) AS height FROM part WHERE p_size > 0),
s AS (SELECT *, least(1920::DOUBLE / width, 1080::DOUBLE / height) AS scale FROM i),
f AS (SELECT p_partkey, CAST(floor(width * scale) AS INTEGER) AS w, CAST(floor(height * scale) AS INTEGER) AS h FROM s)
SELECT p_partkey, w, h, CAST(floor((1920 - w) / 2) AS INTEGER) AS x, CAST(floor((1080 - h) / 2) AS INTEGER) AS y FROM f""")
def q_image_fit(spark, d):
    i = table(spark, d, "part").where("p_size > 0").selectExpr("p_partkey", "p_size * 20 AS width", "cast(floor(p_retailprice / 4) as int) AS height")
    return i.select("p_partkey", media.fit_image(F.col("width"), F.col("height")).alias("f")).select("p_partkey", "f.*")


@query("q_voice_names", """
WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '🎬 ' || c_name || ' (Cloned)' WHEN 1 THEN 'cloned_ana_number_' || c_custkey ELSE c_name END AS name FROM customer),
p AS (SELECT *, trim(replace(replace(name, '🎬 ', ''), ' (Cloned)', '')) AS plain FROM n)
SELECT c_custkey, contains(name, '(Cloned)') OR contains(name, 'cloned_') OR contains(name, '🎬') OR contains(name, '(Custom)') AS cloned,
  CASE WHEN starts_with(plain, 'cloned_') THEN 'Ana Number ' || c_custkey ELSE plain END AS clean FROM p""")
def q_voice_names(spark, d):
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('🎬 ', c_name, ' (Cloned)') WHEN 1 THEN concat('cloned_ana_number_', c_custkey) ELSE c_name END")
    return table(spark, d, "customer").select("c_custkey", media.is_cloned(name).alias("cloned"), media.clean_voice_name(name).alias("clean"))


@query("q_preview", f"SELECT doc_id, md5(CASE WHEN length(text) < 100 THEN text || '{media.PREVIEW_TAIL}' ELSE left(text, 500) END) AS preview FROM documents")
def q_preview(spark, d):
    return documents(spark, d).select("doc_id", F.md5(media.preview_text(F.col("text"))).alias("preview"))


@query("q_metadata", rf"SELECT doc_id, CASE WHEN {sql_strip('t')} <> '' AND lower({sql_strip('t')}) NOT IN ('untitled', 'document', '') THEN {sql_strip('t')} END AS title FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Untitled ' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE ' ' || source END AS t FROM documents)")
def q_metadata(spark, d):
    t = F.expr("CASE doc_id % 4 WHEN 0 THEN ' Untitled ' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE concat(' ', source) END")
    return documents(spark, d).select("doc_id", media.metadata_value(t, ["untitled", "document", ""]).alias("title"))


@query("q_narrators", rf"SELECT doc_id, 'Narrator' AS speaker, 1::BIGINT AS dialogues, len({sql_words('text')}) AS n_words, 0.5::DOUBLE AS formality, 0.3::DOUBLE AS excitement, 0.7::DOUBLE AS calmness, 15::DOUBLE AS sentence_words, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents")
def q_narrators(spark, d):
    return speakers.narrators(documents(spark, d))


@query("q_speaker_names", f"WITH {FOUND} SELECT DISTINCT speaker FROM counts")
def q_speaker_names(spark, d):
    return speakers.speaker_counts(_found(spark, d), "conv_id").select("speaker").distinct()


CHUNK_LANGS = " UNION ALL ".join(f"SELECT doc_id, n, c, b, '{lang}' AS lang, len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))) AS hits, {-i} AS o FROM cw" for i, (lang, ws) in enumerate(P.LANG_MARKERS))
LANG_CHUNKS = rf"""cp AS (SELECT doc_id, string_split(text, '. ') AS p FROM documents),
cc AS (SELECT doc_id, CAST(ceil(len(p) / 50) AS INTEGER) AS n, b, array_to_string(p[b * 50 + 1:b * 50 + 50], '. ') AS c FROM cp, unnest(range(0, CAST(ceil(len(p) / 50) AS INTEGER))) AS t(b)),
cw AS (SELECT *, {sql_words('lower(c)')} AS w FROM cc),
cb AS (SELECT doc_id, n, b, c, first(lang ORDER BY hits DESC, o DESC) AS lang, max(hits) AS hits FROM ({CHUNK_LANGS}) GROUP BY doc_id, n, b, c),
cl AS (SELECT doc_id, lang, count(*) / n AS share FROM cb WHERE length(trim(c)) >= 50 AND hits > 0 GROUP BY doc_id, lang, n)"""


@query("q_lang_chunks", f"WITH {LANG_CHUNKS} SELECT doc_id, lang, share FROM cl")
def q_lang_chunks(spark, d):
    return language.chunk_languages(documents(spark, d))


LANG_MERGED = rf"""{LANG_CHUNKS}, {SHARES},
ord_ AS (SELECT unnest([{', '.join(repr(x) for x, _ in P.LANG_MARKERS)}]) AS lang, unnest(range({len(P.LANG_MARKERS)})) AS o),
pr AS (SELECT doc_id, CASE WHEN max(hits) > 0 THEN first(sh.lang ORDER BY hits DESC, o) ELSE 'unknown' END AS lang FROM sh JOIN ord_ USING (lang) GROUP BY doc_id),
mu AS (SELECT doc_id, lang, share, FALSE AS whole FROM cl UNION ALL SELECT doc_id, lang, share * 0.3::DOUBLE, FALSE FROM sh WHERE share > 0.001::DOUBLE UNION ALL SELECT doc_id, lang, 0, TRUE FROM pr),
ms AS (SELECT doc_id, lang, CASE WHEN bool_and(whole) THEN 0.5::DOUBLE ELSE sum(share) END AS share FROM mu GROUP BY doc_id, lang),
mr AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, lang) AS rank, lang, share FROM ms QUALIFY rank <= 5 AND share > 0.005::DOUBLE)"""


@query("q_lang_merged", f"WITH {LANG_MERGED} SELECT * FROM mr")
def q_lang_merged(spark, d):
    return language.merged_languages(documents(spark, d))


@query("q_voice_scored")
def q_voice_scored(spark, d):
    found = _found(spark, d)
    ranked = speakers.speaker_counts(found, "conv_id").join(speakers.traits(found, "conv_id"), ["conv_id", "speaker"])
    return media.scored_voices(ranked, id_col="conv_id")


@query("q_manifest", f"WITH {FOUND} SELECT conv_id AS doc_id, concat('[', string_agg(concat('{{\"speaker\":\"', speaker, '\",\"dialogues\":', dialogues, ',\"n_words\":', n_words, '}}'), ',' ORDER BY speaker), ']') AS manifest FROM counts GROUP BY conv_id")
def q_manifest(spark, d):
    return manifest(speakers.speaker_counts(_found(spark, d), "conv_id").withColumnRenamed("conv_id", "doc_id"))


# --- reports, catalogs and gates ---


def _books(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n")).select("source", F.concat(F.lit("Book "), "source").alias("title"), F.lit("A. Writer").alias("author"), F.lit("English").alias("language"), F.lit("English: 99.0%").alias("breakdown"), "n")


def _chapter_texts(spark, d):
    """Chapters are found on numbers of pages alone; texts are exchanged twice, to the numbers of their chapters and to these."""
    ranges = toc.chapter_ranges(toc.deduplicate(toc_entries(spark, d)), documents(spark, d))
    pages = toc.chapter_pages(ranges, places(spark, d)).join(documents(spark, d).select("source", "doc_id", "text"), ["source", "doc_id"])
    parts = F.sort_array(F.collect_list(F.struct("page_idx", "text")))
    text = F.array_join(F.transform("x", lambda s: s["text"]), "\n\n")
    chapters = pages.groupBy("source", "chapter_no", "title", "start_page", "end_page").agg(parts.alias("x")).withColumn("text", text)
    return reports.chapter_texts(chapters, _books(spark, d))


CHAPTER_TEXTS = RANGES + """,
ct AS (SELECT r.source, chapter_no, title, start_page, end_page, string_agg(text, chr(10) || chr(10) ORDER BY p.page_idx) AS text FROM ranges r JOIN pages_ p ON p.source = r.source AND p.page_idx >= start_page AND p.page_idx < end_page GROUP BY ALL),
cf_ AS (SELECT source, chapter_no, title, concat('chapter_', lpad(CAST(chapter_no AS VARCHAR), 2, '0'), '_', left(regexp_replace(regexp_replace(trim(title), '[^a-zA-Z0-9_\\-\\s]', '', 'g'), '\\s+', '_', 'g'), 50), '.txt') AS file,
  concat(start_page + 1, '-', end_page) AS pages,
  concat('Book ', source, ' by A. Writer', chr(10), chr(10), 'Chapter ', chapter_no, ': ', title, chr(10), chr(10), text, chr(10), chr(10), 'End of Chapter ', chapter_no, ' of Book ', source, ' by A. Writer.', chr(10)) AS content FROM ct WHERE trim(text) <> '')"""


@query("q_chapter_files", f"WITH RECURSIVE {CHAPTER_TEXTS} SELECT source, chapter_no, title, file, pages, md5(content) AS content FROM cf_")
def q_chapter_files(spark, d):
    return _chapter_texts(spark, d).withColumn("content", F.md5("content"))


@query("q_chapter_index", f"""WITH RECURSIVE {CHAPTER_TEXTS}
SELECT source, md5(concat('CHAPTER INDEX', chr(10), repeat('=', 50), chr(10), chr(10), rtrim(string_agg(concat('Chapter ', lpad(CAST(chapter_no AS VARCHAR), 2, '0'), ': ', title, chr(10), '  File: ', file, chr(10), '  Pages: ', pages, chr(10), '  Printed Page: N/A', chr(10)), chr(10) ORDER BY chapter_no), chr(10)), chr(10))) AS report
FROM cf_ GROUP BY source""")
def q_chapter_index(spark, d):
    return reports.chapter_index(_chapter_texts(spark, d)).withColumn("report", F.md5("report"))


@query("q_contents", f"""WITH RECURSIVE {SECTIONS},
pn AS (SELECT *, CASE section WHEN 'front' THEN 1 WHEN 'main' THEN 2 ELSE 3 END AS part FROM sec),
nn AS (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY page_idx, ord) AS no FROM pn),
bk AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
tx AS (SELECT source, string_agg(concat(part, '.', no, ' ', regexp_replace(title, '^\\d+[.)]\\s*', ''), '  → page ', page_idx + 1), chr(10) ORDER BY part, no) AS t FROM nn GROUP BY source)
SELECT source, md5(concat(regexp_replace(concat('Title: Book ', source, chr(10), 'Author: A. Writer', chr(10), 'Primary Language: English', chr(10), 'Language breakdown: English: 99.0%', chr(10), 'Images extracted: ', n, chr(10), 'Table of Contents:', chr(10), t), '\\s+$', ''), chr(10))) AS report FROM bk JOIN tx USING (source)""")
def q_contents(spark, d):
    entries = toc.sections(toc.deduplicate(toc_entries(spark, d)))
    return reports.contents_report(entries, _books(spark, d).withColumnRenamed("n", "images")).withColumn("report", F.md5("report"))


@query("q_section_pages", f"""WITH RECURSIVE {SECTIONS},
s1 AS (SELECT source, max(page_idx) FILTER (section = 'front') AS front, min(page_idx) FILTER (section = 'main') AS main_, max(page_idx) FILTER (section = 'main') AS last_, min(page_idx) FILTER (section = 'rear') AS rear FROM sec GROUP BY source),
s2 AS (SELECT s1.*, n_pages FROM s1 JOIN (SELECT source, count(*) AS n_pages FROM pages_ GROUP BY source) USING (source))
SELECT source, 'front' AS section, page_idx FROM s2 JOIN pages_ USING (source) WHERE page_idx <= front
UNION ALL SELECT source, 'main', page_idx FROM s2 JOIN pages_ USING (source) WHERE page_idx BETWEEN main_ AND last_
UNION ALL SELECT source, 'rear', page_idx FROM s2 JOIN pages_ USING (source) WHERE page_idx >= coalesce(rear, last_ + 1, 0)""")
def q_section_pages(spark, d):
    return toc.section_pages(toc.deduplicate(toc_entries(spark, d)), documents(spark, d))


@query("q_bookmarks", "SELECT source, CAST(doc_id AS INTEGER) AS ord, trim(left(regexp_extract(text, '^[^\\n]*', 0), 25)) AS title, CAST(doc_id % 40 AS INTEGER) AS page_idx FROM documents WHERE doc_id % 5 = 0")
def q_bookmarks(spark, d):
    marks = documents(spark, d).where("doc_id % 5 = 0").select("source", F.col("doc_id").cast("int").alias("ord"), F.lit(1).alias("level"), F.left(F.regexp_extract("text", r"^[^\n]*", 0), F.lit(25)).alias("title"), (F.col("doc_id") % 40 + 1).alias("page"))
    return toc.bookmark_entries(marks)


@query("q_file_chapters", """
WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Chapter_' || p_partkey || '_' || replace(p_name, ' ', '_') WHEN 1 THEN 'ch ' || p_size WHEN 2 THEN 'chapter' || p_size ELSE replace(lower(p_name), ' ', '_') END AS stem FROM part),
n AS (SELECT p_partkey, stem, coalesce(nullif(regexp_extract(lower(stem), 'chapter[_\\s]*(\\d+)', 1), ''), CAST(p_partkey AS VARCHAR)) AS number, replace(regexp_replace(stem, '(?i)chapter[_\\s]*\\d+[_\\s]*', '', 'g'), '_', ' ') AS rest FROM f),
c AS (SELECT *, array_to_string(list_transform(string_split(rest, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS titled FROM n)
SELECT p_partkey, number, 'Chapter ' || number || CASE WHEN length(stem) > 10 AND titled <> '' THEN ': ' || left(titled, 50) ELSE '' END AS title FROM c""")
def q_file_chapters(spark, d):
    stem = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('Chapter_', p_partkey, '_', replace(p_name, ' ', '_')) WHEN 1 THEN concat('ch ', p_size) WHEN 2 THEN concat('chapter', p_size) ELSE replace(lower(p_name), ' ', '_') END")
    return table(spark, d, "part").select("p_partkey", media.chapter_of_file(stem, F.col("p_partkey")).alias("c")).select("p_partkey", "c.*")


@query("q_slides", "SELECT p_partkey, CASE WHEN k > 0 THEN greatest(a / k, 2) ELSE 5 END AS planned, CASE WHEN k > 0 THEN a / k END AS shown FROM (SELECT p_partkey, p_size % 12 AS k, p_retailprice::DOUBLE AS a FROM part)")
def q_slides(spark, d):
    return table(spark, d, "part").select("p_partkey", media.slide_seconds(F.col("p_retailprice").cast("double"), F.col("p_size") % 12).alias("s")).select("p_partkey", "s.*")


@query("q_clip_totals", """SELECT conv_id, count(*) AS total_clips, round(sum(n) * 8 / 100.0::DOUBLE, 2) AS total_duration, sum(n % 97) / count(*) AS rms, max(n % 89) AS max_amplitude, least(count(*) / 10.0::DOUBLE, 1) AS quality
FROM (SELECT conv_id, length(text) AS n FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id""")
def q_clip_totals(spark, d):
    n = F.length("text")
    clips = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", F.col("turn").alias("clip_no"), (n * 8 / 100.0).alias("duration_s"), (n % 97).alias("rms"), (n % 89).alias("max_amplitude"))
    return media.clip_totals(clips)


@query("q_catalog", """WITH a AS (SELECT left(n_name, 3) AS name, n_name AS voice, 0 AS source, n_nationkey AS at_ FROM nation UNION ALL SELECT left(r_name, 3), r_name, 1, r_regionkey FROM region)
SELECT name, first(voice ORDER BY source DESC, at_ DESC) AS voice, first(source ORDER BY source, at_) AS source, first(at_ ORDER BY source, at_) AS at FROM a GROUP BY name""")
def q_catalog(spark, d):
    n = table(spark, d, "nation").select(F.left("n_name", F.lit(3)).alias("name"), F.col("n_name").alias("voice"), F.col("n_nationkey").alias("ord"))
    r = table(spark, d, "region").select(F.left("r_name", F.lit(3)).alias("name"), F.col("r_name").alias("voice"), F.col("r_regionkey").alias("ord"))
    return media.united_catalog([n, r])


@query("q_voice_slug", """WITH q AS (SELECT DISTINCT 'cloned_' || replace(lower(left(n_name, 9)), ' ', '_') AS voice_id FROM nation)
SELECT voice_id, coalesce((SELECT arg_min(n_name, n_nationkey) FROM nation WHERE replace(lower(n_name), ' ', '_') = replace(voice_id, 'cloned_', '')), 'Narrator') AS name FROM q""")
def q_voice_slug(spark, d):
    n = table(spark, d, "nation")
    asked = n.select(F.concat(F.lit("cloned_"), F.replace(F.lower(F.left("n_name", F.lit(9))), F.lit(" "), F.lit("_"))).alias("voice_id")).distinct()
    return media.voices_by_slug(asked, n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name")), "Narrator")


@query("q_outputs", """WITH c AS (SELECT conv_id AS doc_id, turn, length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS n FROM conversations),
r AS (SELECT doc_id, n % 7 <> 0 AS ok, n * 8 AS ms, n * 20 AS bytes FROM c WHERE n >= 10)
SELECT doc_id, count(*) AS chunks, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN ok THEN ms ELSE 0 END) AS BIGINT) AS total_ms,
  sum(CASE WHEN ok THEN ms ELSE 0 END) > 1000 AND sum(CASE WHEN ok THEN bytes ELSE 0 END) > 1024 AS accepted FROM r GROUP BY doc_id""")
def q_outputs(spark, d):
    chunks = media.synthesis_gate(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), F.col("text").alias("chunk")))
    n = F.col("n_chars")
    return media.output_gate(chunks.select("doc_id", "chunk_no", (n % 7 != 0).alias("ok"), (n * 8).alias("ms"), (n * 20).alias("bytes")))


@query("q_merged_traits", rf"""WITH {FOUND},
j AS (SELECT conv_id, speaker, string_agg(words, ' ' ORDER BY line_no, k) AS t, list(words ORDER BY line_no, k)[1:3] AS s FROM found GROUP BY conv_id, speaker),
c AS (SELECT conv_id, speaker, s, {_count_sql(P.FORMAL)} AS f, {_count_sql(P.CASUAL)} AS c, {_count_sql(P.CALM)} AS m, greatest(len(string_split_regex(t, '[.!?]+')), 1) AS n FROM j)
SELECT speaker, CAST(sum(dialogues) AS BIGINT) AS dialogues, CAST(sum(n_words) AS BIGINT) AS n_words, arg_min(f / greatest(f + c, 1), conv_id) AS formality, arg_min(m / n, conv_id) AS calmness,
  md5(string_agg(array_to_string(s, '|'), '|' ORDER BY conv_id)) AS snippets FROM counts JOIN c USING (conv_id, speaker) GROUP BY speaker""")
def q_merged_traits(spark, d):
    found = _found(spark, d)
    out = speakers.merge_traits(speakers.speaker_counts(found, "conv_id"), speakers.traits(found, "conv_id"), "conv_id")
    return out.select("speaker", "dialogues", "n_words", "formality", "calmness", F.md5(F.array_join("snippets", "|")).alias("snippets"))


@query("q_preset_lookup", """WITH p AS (SELECT DISTINCT 'style' || p_size AS style, p_size + 20 AS top_k FROM part WHERE p_size <= 25)
SELECT o_orderkey, coalesce((SELECT top_k FROM p WHERE style = 'style' || (o_orderkey % 50)), (SELECT top_k FROM p WHERE style = 'style7')) AS top_k FROM orders""")
def q_preset_lookup(spark, d):
    presets = table(spark, d, "part").where("p_size <= 25").select("p_size").distinct().selectExpr("concat('style', p_size) AS style", "p_size + 20 AS top_k")
    asked = table(spark, d, "orders").selectExpr("o_orderkey", "concat('style', o_orderkey % 50) AS style")
    return reports.preset_of(asked, presets, "style7").select("o_orderkey", "top_k")


@query("q_language_report", f"""WITH {LANG_MERGED},
ln AS (SELECT *, CASE lang WHEN 'en' THEN 'English' WHEN 'unknown' THEN 'Unknown' ELSE upper(left(lang, 1)) || substr(lang, 2) END AS name FROM mr)
SELECT doc_id, first(name ORDER BY rank) OVER (PARTITION BY doc_id ORDER BY rank) AS primary, rank, name, round(share * 100, 2) AS percent FROM ln""")
def q_language_report(spark, d):
    return language.language_report(language.merged_languages(documents(spark, d)))


# --- pages, and contents lines on them ---

SCAN_TEXT = r"""concat(text, chr(10), CASE WHEN page_idx % 3 < 2 THEN concat('Part ', page_idx // 4, ' ..... ', page_idx // 4 * 4 + 1) ELSE '-' END, chr(10),
  CASE WHEN doc_id % 5 > 0 THEN concat(left(regexp_extract(text, '^[^\n]*', 0), 20), ' - - ', page_idx * 2) ELSE '--' END, chr(10), CASE WHEN page_idx % 6 < 5 THEN concat('Page ', page_idx + 1) ELSE 'no label here' END)"""


def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    """Books by language, whose pages end in contents lines and, most of them, a printed label."""
    docs = documents(spark, d).select(F.col("lang").alias("source"), "doc_id", "text")
    rows = numbered(docs.select("source", "doc_id"), "source", "doc_id", "page_idx").join(docs, ["source", "doc_id"])
    return rows.select("source", "page_idx", F.expr(SCAN_TEXT.replace("//", "div")).alias("text"))


TOC_RX = r"^\s*(.+?)[.\-\s]{2,}(\d+)\s*$"


@query("q_contents_scan", rf"""WITH
p0 AS (SELECT lang AS source, doc_id, text, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER) AS page_idx FROM documents),
p AS (SELECT source, page_idx, {SCAN_TEXT} AS text FROM p0),
lb AS (SELECT source, page_idx, page_idx + 1 AS label FROM p WHERE page_idx % 6 < 5),
l AS (SELECT source, page_idx AS found_on, i - 1 AS line_no, translate({sql_strip('x[i]')}, '–—‒', '---') AS l FROM (SELECT source, page_idx, string_split(text, chr(10)) AS x FROM p), unnest(range(1, len(x) + 1)) AS t(i)),
c AS (SELECT source, found_on, line_no, regexp_replace({sql_strip(f"regexp_extract(l, '{TOC_RX}', 1)")}, '[.\-\s–—_]+$', '') AS title, regexp_extract(l, '{TOC_RX}', 2) AS printed FROM l WHERE regexp_matches(l, '{TOC_RX}')),
e AS (SELECT source, found_on, line_no, title, printed, (SELECT min(page_idx) FROM lb WHERE lb.source = c.source AND label >= CAST(printed AS INTEGER)) AS page_idx FROM c),
f AS (SELECT source, title, page_idx, min(found_on * 4294967296 + line_no) AS ord, first(printed ORDER BY found_on, line_no) AS printed, min(found_on) AS found_on FROM e WHERE page_idx IS NOT NULL GROUP BY source, title, page_idx),
s AS (SELECT source, min(page_idx) AS stop FROM p WHERE page_idx > 50 AND (source, page_idx) NOT IN (SELECT (source, found_on) FROM f) GROUP BY source)
SELECT f.* FROM f LEFT JOIN s USING (source) WHERE stop IS NULL OR found_on <= stop""")
def q_contents_scan(spark, d):
    return toc.scan_contents(contents_pages(spark, d))


FILE_PAGES = 50


def _page_files(spark, d) -> str:
    """The books' pages as files, which Spark writes from the table."""
    folder = scratch_folder(spark, "pages")
    write_pages(book_pages(spark, d), folder, FILE_PAGES)
    return folder


BOOK = "regexp_extract(book, 'source=([^/]*)$', 1)"


@query("q_page_files", f"WITH {PAGES} SELECT source, page_idx, length(text) AS n_chars, md5(text) AS text FROM pages_")
def q_page_files(spark, d):
    return feed_pages(spark, _page_files(spark, d)).select(F.expr(BOOK).alias("source"), "page_idx", F.length("text").alias("n_chars"), F.md5("text").alias("text"))


def page_again(file, at: int) -> str | None:
    """A second source for the query: every third poor page has none."""
    return None if at % 3 == 2 else f"page {at} read again"


@query("q_page_decoder", rf"""WITH {PAGES}
SELECT source, page_idx, md5(CASE WHEN length({sql_strip('text')}) < 100 AND page_idx % {FILE_PAGES} % 3 < 2 THEN 'page ' || (page_idx % {FILE_PAGES}) || ' read again' ELSE text END) AS text FROM pages_""")
def q_page_decoder(spark, d):
    rows = decoded_pages(spark, _page_files(spark, d), "quillspark.sources.pages:feed_decoder", "quillspark.queries:page_again", ".txt", 1)
    return rows.select(F.expr(BOOK).alias("source"), "page_idx", F.md5("text").alias("text"))


@query("q_second_source", rf"""WITH s AS (SELECT conv_id, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT doc_id, md5(CASE WHEN coalesce(length({sql_strip('d.text')}), 0) < 100 THEN coalesce(s.text, d.text) ELSE d.text END) AS text FROM documents d LEFT JOIN s ON conv_id = doc_id""")
def q_second_source(spark, d):
    second = table(spark, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("doc_id"), "text")
    return with_second_source(documents(spark, d).select("doc_id", "text"), second, ["doc_id"]).select("doc_id", F.md5("text").alias("text"))


@query("q_blank_pages", rf"""SELECT doc_id, length({sql_strip('t')}) = 0 AS no_text, length({sql_strip('t')}) = 0 AND doc_id % 3 = 0 AS blank
FROM (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN chr(9) || ' ' ELSE text END AS t FROM documents)""")
def q_blank_pages(spark, d):
    t = F.expr("CASE doc_id % 2 WHEN 0 THEN '\t ' ELSE text END")
    return documents(spark, d).select("doc_id", lines.low_quality(t, 1).alias("no_text"), blank_page(t, (F.col("doc_id") % 3).cast("int")).alias("blank"))


# --- streams ---

ARRIVALS, FILES, LATE_S, DELAY, STATE_PARTS = 3, 4, 7200, "4 hours", 8


@query("q_captions_stream", ORACLES["q_captions"])
def q_captions_stream(spark, d):
    """The captions of `q_captions` as they arrive in some batches, part of them late; the last row moves the watermark past all."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("ord"), F.lit(0.0).alias("duration"), F.col("event_type").alias("text"))
    came = rows.withColumn("came", (F.unix_micros("ts") / 1e6 + F.col("ord") % 5 * (LATE_S / 4)))
    cuts = [float("-inf"), *came.approxQuantile("came", [i / ARRIVALS for i in range(1, ARRIVALS)], 0.01), float("inf")]
    folder = scratch_folder(spark, "captions")
    for low, high in zip(cuts, cuts[1:]):
        came.where((F.col("came") >= low) & (F.col("came") < high)).drop("came").repartition(FILES).write.mode("append").parquet(f"{folder}/in")
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select(F.lit(None).cast("string").alias("video_id"), "ts", F.lit(0).cast("long").alias("ord"), F.lit(0.0).alias("duration"), F.lit("end").alias("text"))
    end.write.mode("append").parquet(f"{folder}/in")
    out = captions.speakers_of_files(spark, f"{folder}/in", "video_id string, ts timestamp, ord long, duration double, text string", CAPTION_GAP, DELAY, f"{folder}/out", f"{folder}/checkpoint", FILES, STATE_PARTS)
    g = out.groupBy(F.col("video_id").cast("long").alias("user_id"), "speaker").agg(F.sum(T.n_words(F.col("text"))).alias("n_words"), F.count("*").alias("captions"))
    return g.where("n_words > 1")


@query("q_catalog_refresh", """WITH b AS (SELECT left(s_name, 15) || (s_suppkey % 50) AS name, CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE CAST(s_suppkey % 100 AS DOUBLE) / 100 END AS quality, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS created, CAST(s_nationkey AS INTEGER) AS clips, s_suppkey % 3 AS batch FROM supplier),
l AS (SELECT name, batch, first(coalesce(quality, 0) ORDER BY created DESC) AS quality, max(created) AS created, first(clips ORDER BY created DESC) AS clips FROM b GROUP BY name, batch)
SELECT name, arg_max(quality, batch) AS quality, arg_max(created, batch) AS created, arg_max(clips, batch) AS clips, min(batch) AS first_batch, max(batch) AS batch FROM l GROUP BY name""")
def q_catalog_refresh(spark, d):
    """Profiles made from suppliers arrive in three batches; the second arrives twice, and the first two are compacted."""
    s = table(spark, d, "supplier")
    rows = s.select(
        F.concat(F.left("s_name", F.lit(15)), F.col("s_suppkey") % 50).alias("name"), F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 100).cast("double") / 100).alias("quality"),
        F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("created"), F.col("s_nationkey").cast("int").alias("clips"), (F.col("s_suppkey") % 3).alias("batch"),
    )
    folder = scratch_folder(spark, "profiles")
    for k in range(3):
        rows.where(F.col("batch") == k).drop("batch").write.json(f"{folder}/in/{k}")
        catalog.refresh(spark, f"{folder}/in/*", f"{folder}/catalog", f"{folder}/checkpoint")
        if k == 1:
            catalog.upsert(rows.where(F.col("batch") == 1).drop("batch"), 1, f"{folder}/catalog")
            catalog.compact(spark, f"{folder}/catalog", 1)
    return catalog.read_catalog(spark, f"{folder}/catalog")


# --- timelines, spoken forms, names and voices ---

TIMELINES = " UNION ALL ".join(
    f"""SELECT doc_id, '{name}' AS profile, chunk_no, est_ms, {lead} + {before} * CAST(chunk_no > 0 AS INTEGER) + coalesce(sum(own) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, {lead} + sum(own) OVER (PARTITION BY doc_id) AS total_ms
FROM (SELECT *, CASE WHEN chunk_no > 0 THEN {before} ELSE 0 END + est_ms + CASE WHEN chunk_no = last_ THEN {last} ELSE {after} END AS own FROM te WHERE n >= {render.SHORTEST.get(name, 0)})"""
    for name, (lead, before, after, last) in render.PROFILES.items()
)


@query("q_timelines", f"""WITH RECURSIVE {CHUNKS.replace('>= 20', '>= 1')},
te AS (SELECT doc_id, chunk_no, length(chunk) AS n, CAST(floor(greatest(1.0, length(chunk) * 0.08::DOUBLE) * 1000) AS BIGINT) AS est_ms, max(chunk_no) OVER (PARTITION BY doc_id) AS last_ FROM chunks)
SELECT *, start_ms + est_ms AS end_ms FROM ({TIMELINES})""")
def q_timelines(spark, d):
    chunks = documents(spark, d).select("doc_id", F.posexplode(chunking.pack_trailing(F.col("text"), 250, 1)).alias("chunk_no", "chunk"))
    return render.timelines(chunks, list(render.PROFILES)).select("doc_id", "profile", "chunk_no", "est_ms", "start_ms", "end_ms", "total_ms")


# Ten shapes of sentences; each rule of the spoken forms fires in one of them.
SHAPES = [
    "'At 7 A.M. or 8 p.m. Order ' || k || ' left; PM and AM.'", "'The U.S.A. and the u.k. and the F.B.I. asked the C.I.A. about N.A.S.A. ' || k", "'USA, UK, FBI, CIA, NASA: ' || k", "'Jo Roe, Ph.D. and M.D., M.A. or BA, no. ' || k",
    "'Dr. A, Mr. B, Mrs. C, Ms. D, Prof. E of St. F, Ave. G, Rd. ' || k", "k % 9 || ' ft and ' || k % 7 || ' in. by ' || k % 5 || 'lbs, ' || k % 3 || ' lb.'", "k % 80 || ' kg. at ' || k % 120 || 'mph or ' || k % 200 || ' km/h'",
    "'Since 1' || (900 + k % 99) || ' and 20' || (10 + k % 89) || ', not 1899.'", "(k % 999) || ',' || (100 + k % 899) || ' and 1,234,567 of ' || k", "'M. Frank met J. R. Roe and b. Cole ' || k",
]


def _spoken_sql(x: str) -> str:
    for rx, to in [*P.SPELT, *P.DEGREES, *P.TITLES, *P.UNITS, *P.NUMBERS]:
        x = f"regexp_replace({x}, '{rx}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


SHAPED = "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SHAPES)) + " END AS t FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)"


@query("q_spoken_forms", f"SELECT o_orderkey, {_spoken_sql('t')} AS spoken FROM ({SHAPED})")
def q_spoken_forms(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"))
    t = F.expr("CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SHAPES)) + " END")
    return rows.select("o_orderkey", T.spoken(t).alias("spoken"))


TITLED = "array_to_string(list_transform(regexp_extract_all(t, '[\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"


@query("q_title_case", f"SELECT doc_id, {TITLED} AS titled FROM (SELECT doc_id, concat('o''neil-', upper(left(source, 3)), '_', left(replace(text, 'ß', 's'), 60)) AS t FROM documents)")
def q_title_case(spark, d):
    t = F.expr("concat('o\\'neil-', upper(left(source, 3)), '_', left(replace(text, 'ß', 's'), 60))")
    return documents(spark, d).select("doc_id", T.title_case(t).alias("titled"))


@query("q_chunk_size", "SELECT p_partkey, greatest(100, least(400, p_size * 12)) AS chunk_size, greatest(80, least(600, p_size * 20)) AS preview_size FROM part")
def q_chunk_size(spark, d):
    return table(spark, d, "part").select("p_partkey", T.clamp(F.col("p_size") * 12, 100, 400).alias("chunk_size"), T.clamp(F.col("p_size") * 20, 80, 600).alias("preview_size"))


@query("q_stabilized", f"""WITH RECURSIVE {CHUNKS}, l AS (SELECT doc_id, max(chunk_no) AS last_ FROM chunks GROUP BY doc_id)
SELECT doc_id, chunk_no, md5(CASE WHEN chunk_no > 0 AND chunk_no < last_ THEN upper(left(chunk, 1)) || substr(chunk, 2) ELSE chunk END) AS chunk FROM chunks JOIN l USING (doc_id)""")
def q_stabilized(spark, d):
    chunks = T.middle_capitals(F.col("x"))
    return documents(spark, d).select("doc_id", chunking.pack_trailing(F.col("text"), 250, 20).alias("x")).select("doc_id", F.posexplode(chunks).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.md5("c").alias("chunk"))


GREEDY = rf"""{FOUND},
gj AS (SELECT conv_id, speaker, string_agg(words, ' ' ORDER BY line_no, k) AS t FROM found GROUP BY conv_id, speaker),
gc AS (SELECT conv_id, speaker, {_count_sql(P.FORMAL)} AS f, {_count_sql(P.CASUAL)} AS c, {_count_sql(P.EXCITED, '[!]+|[?!]+|')} AS e, {_count_sql(P.CALM)} AS m, greatest(len(string_split_regex(t, '[.!?]+')), 1) AS n FROM gj),
gs AS (SELECT conv_id, speaker, dialogues, n_words, first_at, f / greatest(f + c, 1) AS formality, e / n AS excitement, m / n AS calmness FROM counts JOIN gc USING (conv_id, speaker)),
gr AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY dialogues DESC, first_at) AS rk FROM gs),
ga(conv_id, rk, used, speaker, voice_id) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM gr
  UNION ALL
  SELECT conv_id, rk, list_append(used, voice), speaker, voice FROM (
    SELECT gr.conv_id, gr.rk, used, gr.speaker, coalesce(
      list_filter([CASE WHEN formality > 0.7 THEN 'david_male_us' WHEN excitement > 0.5 THEN 'jenny_female_us' WHEN calmness > 0.5 THEN 'mary_female_uk' END], lambda v: v IS NOT NULL AND NOT list_contains(used, v))[1],
      list_filter(['jenny_female_us', 'david_male_us', 'mary_female_uk', 'narrator_neutral'], lambda v: NOT list_contains(used, v))[1]) AS voice
    FROM ga JOIN gr ON gr.conv_id = ga.conv_id AND gr.rk = ga.rk + 1) WHERE voice IS NOT NULL)"""
ORACLES["q_voice_greedy"] = f"WITH RECURSIVE {GREEDY} SELECT conv_id, speaker, voice_id FROM ga WHERE rk > 0"


@query("q_voice_default", f"WITH RECURSIVE {GREEDY} SELECT counts.conv_id, counts.speaker, coalesce(voice_id, 'narrator_neutral') AS voice_id FROM counts LEFT JOIN (SELECT * FROM ga WHERE rk > 0) a USING (conv_id, speaker)")
def q_voice_default(spark, d):
    counts = speakers.speaker_counts(_found(spark, d), "conv_id")
    return speakers.voices_or_default(counts, QUERIES["q_voice_greedy"](spark, d), "narrator_neutral", "conv_id").select("conv_id", "speaker", "voice_id")


CUT = r"""
ds AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE trim(text) <> ''),
cut(doc_id, i, cur, out) AS (
  SELECT doc_id, 0, '', []::VARCHAR[] FROM ds
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN x IS NULL THEN '' WHEN length(x) > 200 THEN substr(x, (length(x) - 1) // 200 * 200 + 1) WHEN length(cur) + length(x) + 1 <= 200 THEN trim(concat(cur, ' ', x)) ELSE x END,
    CASE WHEN x IS NULL THEN [cur] WHEN length(x) > 200 THEN list_append(list_transform(range(0, (length(x) - 1) // 200), lambda k: substr(x, CAST(k * 200 + 1 AS BIGINT), 200)), cur)
      WHEN length(cur) + length(x) + 1 <= 200 THEN [] ELSE [cur] END
  FROM (SELECT cut.doc_id, i, cur, s[i + 1] AS x FROM cut JOIN ds USING (doc_id) WHERE i <= len(s)))"""
ORACLES["q_chunk_v4"] = f"""WITH RECURSIVE {CUT},
e AS (SELECT doc_id, i, j, regexp_replace(regexp_replace(out[j], '^\\s+', ''), '\\s+$', '') AS c FROM cut, unnest(range(1, len(out) + 1)) AS t(j))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_no, length(c) AS n_chars, md5(c) AS chunk FROM e WHERE c <> ''"""
ORACLES["q_chunk_v5"] = r"""WITH RECURSIVE
dp AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS p FROM documents WHERE trim(text) <> ''),
ds AS (SELECT doc_id, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM dp WHERE length(p) + 2 > 5000),
pk(doc_id, i, cur, out) AS (
  SELECT doc_id, 0, '', NULL::VARCHAR FROM ds
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN x IS NULL THEN '' WHEN length(cur) + length(x) + 1 <= 5000 THEN CASE WHEN cur = '' THEN x ELSE concat(cur, ' ', x) END ELSE x END, CASE WHEN x IS NULL OR length(cur) + length(x) + 1 > 5000 THEN cur END
  FROM (SELECT pk.doc_id, i, cur, s[i + 1] AS x FROM pk JOIN ds USING (doc_id) WHERE i <= len(s))),
e AS (SELECT doc_id, i, out AS c FROM pk WHERE length(out) >= 30 UNION ALL SELECT doc_id, 0, p FROM dp WHERE length(p) + 2 <= 5000 AND length(p) >= 30)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, length(c) AS n_chars, md5(c) AS chunk FROM e"""


# --- books with title pages, and notes of voices ---

TITLE_PAGE = r"""CASE page_idx WHEN 0 THEN concat('Page of ', source, chr(10), 'by ', upper(left(source, 1)), 'ara Mill-Roe') WHEN 1 THEN CASE length(source) % 2 WHEN 0 THEN concat('THE LONG ROAD ', upper(source)) ELSE 'My Life, a Memoir' END
  WHEN 2 THEN concat('The Tale of a ', source, ' Story') WHEN 3 THEN 'Author: Jo Bell' ELSE 'chapter one' END"""
TITLED_PAGES = f"pages_ AS (SELECT source, page_idx, concat({TITLE_PAGE}, chr(10), text) AS text FROM (SELECT source, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_idx FROM documents))"


def titled_pages(spark: SparkSession, d: str, n: int) -> DataFrame:
    return first_pages(spark, d, n).select("source", "page_idx", F.concat(F.expr(TITLE_PAGE), F.lit("\n"), "text").alias("text"))


@query("q_book_titles", ORACLES["q_title"].replace(PAGES, TITLED_PAGES))
def q_book_titles(spark, d):
    return metadata.titles(titled_pages(spark, d, 5))


@query("q_book_authors", ORACLES["q_author"].replace(PAGES, TITLED_PAGES))
def q_book_authors(spark, d):
    return metadata.authors(titled_pages(spark, d, 3))


@query("q_voice_notes", """WITH c AS (SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS VARCHAR) AS s, least(count(*) / 10.0::DOUBLE, 1) AS q FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, concat('# Voice Model: v', conv_id, chr(10), chr(10), '## Files', chr(10), '- `voice_profile.json`: characteristics', chr(10), '- `voice_samples/`: ', n, ' sample clips', chr(10), chr(10), '## Statistics', chr(10), '- Total samples: ', n, chr(10),
  '- Total duration: ', s, 's', chr(10), '- Quality score: ', printf('%.2f', q), chr(10), chr(10), '## Source', chr(10), CASE WHEN conv_id % 2 = 0 THEN 'talk' ELSE 'unknown' END, chr(10)) AS notes FROM c""")
def q_voice_notes(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("s"), media.profile_quality(F.count("*")).alias("q"))
    origin = F.when(F.col("conv_id") % 2 == 0, "talk")
    return c.select("conv_id", reports.voice_notes(F.concat(F.lit("v"), "conv_id"), F.col("n"), F.col("s").cast("string"), F.col("q"), origin).alias("notes"))

ORACLES["q_voice_scored"] = "WITH RECURSIVE " + GREEDY[: GREEDY.index("gr AS")] + f"""gr AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY dialogues + n_words / 100 DESC, first_at) AS rk FROM gs),
ga(conv_id, rk, used, speaker, voice_id) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM gr
  UNION ALL
  SELECT conv_id, rk, list_append(used, voice), speaker, voice FROM (
    SELECT gr.conv_id, gr.rk, used, gr.speaker, list_filter(list_concat(CASE WHEN formality > 0.7 THEN ['p231', 'p240'] WHEN excitement > 0.6 THEN ['p233', 'p245'] WHEN calmness > 0.6 THEN ['p228', 'p234', 'p236'] ELSE [] END,
      [{", ".join(repr(v) for v, *_ in P.SCORED_VOICES)}]), lambda v: NOT list_contains(used, v))[1] AS voice
    FROM ga JOIN gr ON gr.conv_id = ga.conv_id AND gr.rk = ga.rk + 1) WHERE voice IS NOT NULL)
SELECT conv_id, speaker, voice_id FROM ga WHERE rk > 0"""
ORACLES["q_clip_repeat"] = """WITH RECURSIVE
c AS (SELECT conv_id, turn AS clip_no, length(text) * 0.08::DOUBLE AS duration_s FROM conversations WHERE length(text) * 0.08::DOUBLE BETWEEN 2 AND 10),
r AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(duration_s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS laid FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY duration_s DESC, clip_no)),
f AS (SELECT conv_id, rank, duration_s FROM r WHERE laid + (rank - 1) * 0.2::DOUBLE < 60),
x AS (SELECT conv_id, list(duration_s ORDER BY rank) AS d, sum(duration_s + 0.2::DOUBLE) AS own FROM f GROUP BY conv_id),
g(conv_id, n, t) AS (SELECT conv_id, len(d), own FROM x UNION ALL SELECT g.conv_id, n + 1, t + d[n % len(d) + 1] + 0.3::DOUBLE FROM g JOIN x USING (conv_id) WHERE t < 60)
SELECT conv_id, CAST(max(n) AS INTEGER) AS clips, max(t) AS total_s FROM g GROUP BY conv_id"""
_ODD = lambda x, mark: f"(length({x}) - length(replace({x}, '{mark}', ''))) % 2 = 1"
ORACLES["q_paragraphs"] = rf"""WITH RECURSIVE
ln AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: {sql_strip('y')}) AS l FROM documents),
ft AS (SELECT doc_id, i, l[i] AS x, len({sql_words('l[i]')}) AS n, regexp_matches(l[i], '^\p{{Lu}}') AS up, regexp_matches(l[i], '^\p{{Ll}}') AS low,
    regexp_matches(l[i], '(?i)^(and|or|but|yet|so|for|nor|because|since|although|though|while|whereas|that|which|who|whom|whose|where|when|why|how|to|from|with|without|under|over|through|during|he|she|it|they|we|you|i)\s') AS joins,
    regexp_matches(l[i], '^((Chapter|Section|Part|\d+\.|•|\*|-)\s|"|[A-Z][a-z]+,|In \d{{4}})') OR (upper(l[i]) = l[i] AND regexp_matches(l[i], '\p{{Lu}}')) AS opens FROM ln, unnest(range(1, len(l) + 2)) AS t(i)),
pr(doc_id, i, par, before, x) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, '', NULL::VARCHAR, NULL::VARCHAR FROM ln
  UNION ALL
  SELECT doc_id, i, CASE WHEN x IS NULL THEN '' WHEN go THEN {sql_strip(r"regexp_replace(par || ' ' || x, '\s+', ' ', 'g')")} ELSE x END, CASE WHEN NOT go AND par <> '' THEN par END, CASE WHEN NOT go AND x = '' THEN x END
  FROM (SELECT ft.doc_id, ft.i, par, ft.x, coalesce(ft.x <> '' AND par <> '' AND NOT (up AND n <= 3) AND ({_ODD('par', '"')} OR length(replace(par, ')', '')) < length(replace(par, '(', '')) OR joins
      OR ((NOT regexp_matches(par, '[.!?:;]$') OR {_ODD('par', "''")} OR low) AND NOT (opens OR (up AND n > 8)))), FALSE) AS go FROM pr JOIN ft ON ft.doc_id = pr.doc_id AND ft.i = pr.i + 1)),
it AS (SELECT doc_id, i * 2 AS at_, before AS t FROM pr WHERE before IS NOT NULL UNION ALL SELECT doc_id, i * 2 + 1, x FROM pr WHERE x IS NOT NULL),
nb AS (SELECT doc_id, at_, t, lag(t) OVER w AS one, coalesce(lag(t = '') OVER o, FALSE) AS gap FROM it WINDOW o AS (PARTITION BY doc_id ORDER BY at_), w AS (PARTITION BY doc_id ORDER BY t = '', at_)),
fi AS (SELECT *, coalesce(NOT regexp_matches(one, '[.!?]$') AND regexp_matches(t, '^\p{{Ll}}') AND NOT regexp_matches(t, '^(chapter|section|part)'), FALSE) AS fits FROM nb WHERE t <> ''),
gr AS (SELECT *, sum(CAST(NOT fits AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY at_) AS g FROM fi),
jo AS (SELECT *, fits AND (row_number() OVER (PARTITION BY doc_id, g, fits ORDER BY at_)) % 2 = 1 AS joined FROM gr),
tx AS (SELECT doc_id, string_agg(CASE WHEN joined THEN ' ' WHEN gap THEN chr(10) || chr(10) ELSE chr(10) END || t, '' ORDER BY at_) AS t FROM jo GROUP BY doc_id)
SELECT doc_id, md5({sql_strip("regexp_replace(coalesce(t, ''), ' {2,}', ' ', 'g')")}) AS text FROM documents LEFT JOIN tx USING (doc_id)"""
