"""Each registered narration query against its SQL, and what SQL can't say against plain Python."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.functions import patterns as P

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n.startswith("q_")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float("%.10g" % v)
    return float("%.10g" % float(v)) if hasattr(v, "quantize") else v


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows or name in entry.oracle_sql() or name == "q_title"
    if name in entry.oracle_sql():
        r = con.execute(entry.oracle_sql()[name])
        cols = [x[0] for x in r.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted((tuple(plain(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall()), key=repr)
        assert sorted((tuple(plain(x[c]) for c in sorted(cols)) for x in rows), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def clause_parts(s, most):
    """Plain version of the clause split."""
    if len(s) <= most:
        return [s]
    for rx, sep in P.CLAUSES:
        pieces = re.split(rx, s)
        cur, out = pieces[0], []
        for p in pieces[1:]:
            cur += sep
            if len(cur + p) > most:
                out.append(cur.strip())
                cur = p
            else:
                cur += p
        out.append(cur.strip())
        if len(out) > 1 and all(len(x) <= most for x in out):
            return out
    return wrap(s, most)


def wrap(s, most):
    out, cur = [], ""
    for w in s.split():
        if len(cur) + len(w) + 1 <= most:
            cur = (cur + " " + w).strip()
        else:
            out += [cur] if cur else []
            cur = w
    return out + ([cur] if cur else [])


def plain_v2(t, most, least):
    t = t.strip()
    s = re.split(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?][\"'])\s+(?=[A-Z])", t)
    s = re.split(r"(?<=[.!?])\s+", t) if len(s) == 1 else s
    out, cur, size = [], [], 0
    for x in [x.strip() for x in s if x.strip()]:
        if len(x) > most:
            out += [" ".join(cur)] if cur else []
            out += [p for p in clause_parts(x, most) if len(p) >= least]
            cur, size = [], 0
        elif size + len(x) + 1 > most:
            out += [" ".join(cur)] if cur else []
            cur, size = [x], len(x)
        else:
            cur.append(x)
            size += len(x) + 1
    last = " ".join(cur)
    if cur and len(last) >= least:
        out.append(last)
    elif cur and out:
        out[-1] += " " + last
    return out


def plain_long(t, most, pieces):
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", t.strip()):
        if len(s) <= most and len(cur) + len(s) + 1 <= most:
            cur = (cur + " " + s).strip()
        elif len(s) <= most:
            out += [cur] if cur else []
            cur = s
        else:
            *full, last = pieces(s, most)
            out += full + ([cur] if cur else [])
            cur = last
    return [c.strip() for c in out + [cur] if c.strip()]


def plain_v5(t, most, least):
    out, cur = [], ""
    for p in filter(None, map(str.strip, t.split("\n\n"))):
        if len(cur) + len(p) + 2 <= most:
            cur = cur + "\n\n" + p if cur else p
            continue
        out += [cur] if len(cur) >= least else []
        cur = p
        if len(p) > most:
            cur = ""
            for s in re.split(r"(?<=[.!?])\s+", p):
                if len(cur) + len(s) + 1 <= most:
                    cur = cur + " " + s if cur else s
                else:
                    out += [cur] if len(cur) >= least else []
                    cur = s
    return out + ([cur] if len(cur) >= least else [])


def test_packers(spark):
    from quillspark.operators import chunking as C
    from pyspark.sql import functions as F

    texts = ["", " ", "One two. Three four five. Six.", "A; b, c and d " * 30, "x" * 700, "No end\n\nBut paragraphs. Yes!\n\n" * 9]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    cut = lambda s, n: [s[i : i + n] for i in range(0, len(s), n)]
    cases = {
        "v2": (C.pack_clauses(t, 250, 30), lambda x: plain_v2(x, 250, 30)), "v3": (C.pack_wrapped(t, 220), lambda x: plain_long(x, 220, wrap)),
        "v4": (C.pack_cut(t, 200), lambda x: plain_long(x, 200, cut)), "v5": (C.pack_paragraphs(t, 300, 30), lambda x: plain_v5(x, 300, 30)),
    }
    for r in df.select("t", *[c.alias(k) for k, (c, _) in cases.items()]).collect():
        for k, (_, f) in cases.items():
            assert r[k] == (f(r.t) if r.t.strip() else []), (k, r.t[:80])


def test_text_units(spark):
    from quillspark.functions import text as T
    from quillspark.functions.nfkc import normalize_text
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.roman(F.lit(x))) for x in ("xiv", "IX", "abc", "", "iix")] == [14, 9, None, None, 10]
    got = [one(T.toc_line(F.lit(x))) for x in ("Introduction ..... 12", "Part One - 7", "Well-known facts  iv", "No page here")]
    assert [tuple(x) if x else None for x in got] == [("Introduction", "12"), ("Part One", "7"), ("Well-known facts", "iv"), None]
    assert one(T.spoken(F.lit("1,234,567 since 2005"))) == "1 thousand 234,567 since twenty 05"
    assert one(normalize_text(F.lit("ﬁ ４²"))) == "fi 42"
    assert one(T.middle_capitals(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a", "B", "c"]


def test_captions_and_slices(spark):
    from quillspark.plans import render

    c = spark.createDataFrame([(1, 0, 0.0, 2.0, "a"), (1, 1, 2.5, 1.0, "b"), (1, 2, 7.0, 1.0, "c"), (1, 3, 9.0, 1.0, ""), (1, 4, 12.0, 1.0, "d")], "video_id int, ord int, start double, duration double, text string")
    got = {r.text: r.speaker[-1] for r in render.diarize(c, 3.0).collect()}
    assert got == {"a": "1", "b": "1", "c": "2", "d": "1"}
    images, chapters = spark.range(7).withColumnRenamed("id", "img_idx"), spark.range(1, 4).withColumnRenamed("id", "chapter_no")
    by = {}
    for r in render.slice_images(images, chapters).collect():
        by.setdefault(r.chapter_no, []).append(r.img_idx)
    assert {k: sorted(v) for k, v in by.items()} == {1: [2, 3], 2: [4, 5], 3: [6]}
    presets = spark.createDataFrame([("a", 0.85, 70, 0.95)], "style string, temperature double, top_k int, speed double")
    r = render.scaled_presets(presets, 1.5).first()
    assert (round(r.temperature, 4), r.top_k, round(r.speed, 4)) == (0.9775, 77, 0.9975)


def test_marginalia_and_chapters(spark):
    from pyspark.sql import functions as F
    from quillspark.operators import lines, paragraphs, speakers, toc

    rows = ["12", "- 7 -", "xiv", "civil", "Chapter 3", "the quick brown fox", "He said 3 things, then left."]
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    assert {r.s for r in df.where(~lines.is_marginalia(F.col("s"))).collect()} == {rows[-1]}
    e = spark.createDataFrame([("b", i, t, p) for i, (t, p) in enumerate([("1 Intro", 3), ("1 Start", 5), ("intro", 3), ("2 Body", 5), ("2 BODY", 9)])], "source string, ord int, title string, page_idx int")
    assert sorted((r.title, r.page_idx) for r in toc.deduplicate(e).collect()) == [("1 Intro", 3), ("2 Body", 5)]
    e = spark.createDataFrame([("a", 0, "1 A", 0), ("a", 1, "2 B", 1), ("a", 2, "5 C", 2), ("b", 0, "5 X", 0)], "source string, ord int, title string, page_idx int")
    assert sorted(r.missing for r in toc.missing_chapters(e).collect()) == [3, 4]
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate(["It was late.", '"Go now" said Alice', "", "He left."])], "doc_id int, line_no int, line string")
    assert [(r.speaker, r.text) for r in speakers.segments(s).orderBy("seg_no").collect()] == [("narrator", "It was late."), ("Alice", "Go now"), ("narrator", "He left.")]
    t = spark.createDataFrame([(0, "The end of\nthe line came late.\n\nNew one here."), (1, None)], "doc_id int, text string")
    assert {tuple(r) for r in paragraphs.rebuild_paragraphs(t).collect()} == {(0, "The end of the line came late.\n\nNew one here."), (1, "")}


def test_sources_and_resume(spark, tmp_path):
    from quillspark.sources import io
    from quillspark.streaming.resume import pending, process_new_files

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("x\ny")
    (tmp_path / "t" / "b.MP3").write_bytes(b"123")
    assert [r.text for r in io.text_files(spark, str(tmp_path / "t")).collect()] == ["x\ny"]
    assert [r.length for r in io.media_files(spark, str(tmp_path / "t"), "audio").collect()] == [3]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "v.json").write_text('{"name": "n"}')
    assert [(r.name, r.quality) for r in io.voice_profiles(spark, str(tmp_path / "p")).collect()] == [("n", 0.0)]
    rows = spark.createDataFrame([(1, 0, "Title: A"), (1, 1, "Author: B"), (1, 2, "Title: C")], "doc_id int, line_no int, line string")
    assert tuple(io.header_values(rows).first()) == (1, "C", "B")
    clips = spark.createDataFrame([(1, 0, "a", None, "a.mp3"), (1, 1, "b", 7.9, "b.mp3")], "doc_id int, ord int, title string, seconds double, path string")
    assert io.playlist(clips).first().m3u8 == "#EXTM3U\n#EXTINF:300,a\na.mp3\n#EXTINF:7,b\nb.mp3\n#EXT-X-ENDLIST\n"
    io.write_chapters(spark.createDataFrame([(1, "T", " body ")], "doc_id int, title string, content string"), str(tmp_path / "c"))
    assert next((tmp_path / "c" / "doc_id=1").glob("*.txt")).read_text() == "=== T ===\n\nbody\n\n"
    a, b = spark.range(5), spark.range(2)
    assert pending(a, b, "id").count() == 3
    a.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        process_new_files(spark, str(tmp_path / "in"), "id long", lambda df: df, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_voice_folds_against_loops(spark):
    """Both assigners over random speakers, against loops that take one speaker after the other."""
    import random

    from quillspark.operators import media, speakers

    rng = random.Random(4)
    rows = [(b, 0, k, f"{rng.choice(['Mary', 'Narrator', 'Mr Bell', 'Ash'])} {k}" if k else "Narrator", rng.randint(1, 9), rng.randint(1, 900), *[rng.choice([0.0, 0.55, 0.65, 0.9]) for _ in range(3)]) for b in range(12) for k in range(rng.randint(1, 30))]
    df = spark.createDataFrame([(b, {"line_no": x, "k": k}, *r) for b, x, k, *r in rows], "doc_id int, first struct<line_no:int,k:int>, speaker string, dialogues int, n_words int, formality double, excitement double, calmness double").repartition(3)
    classes = [("female", ["mary"]), ("male", ["mr "])]

    def greedy(of):
        used, out = [], {}
        for _, _, k, name, n, _, f, e, c in sorted(of, key=lambda r: (-r[4], r[2])):
            want = {"formal", "authoritative"} if f > 0.7 else {"warm"} if e > 0.5 else {"calm", "gentle"} if c > 0.5 else set()
            free = [(v, set(ts)) for v, ts in P.VOICES if v not in used]
            voice = next((v for v, ts in free if ts & want), free[0][0] if free else None)
            if voice:
                used.append(voice)
                out[name] = voice
        return out

    def scored(of, by_class):
        used, out = [], {}
        for _, _, k, name, n, w, f, e, c in sorted(of, key=lambda r: (-(r[4] + r[5] / 100), r[2])):
            want = ("professional", "authoritative") if f > 0.7 else ("bright", "dynamic") if e > 0.6 else ("calm", "gentle", "soft") if c > 0.6 else ()
            kind = next((x for x, ks in by_class for y in ks if y in name.lower()), None)
            best = None
            for v, cls, d in P.SCORED_VOICES:
                points = 10 * (kind == cls) + 5 * any(x in d.lower() for x in want) + 8 * (name.lower() == "narrator" and ("narrator" in d.lower() or "clear" in d.lower()))
                if v not in used and (best is None or points > best[0]):
                    best = (points, v)
            if best:
                used.append(best[1])
                out[name] = best[1]
        return out

    books = {b: [r for r in rows if r[0] == b] for b in range(12)}
    got = {(r.doc_id, r.speaker): r.voice_id for r in speakers.greedy_voices(df).collect()}
    assert got == {(b, s): v for b, of in books.items() for s, v in greedy(of).items()}
    for cs in (None, classes):
        got = {(r.doc_id, r.speaker): r.voice_id for r in media.scored_voices(df, classes=cs).collect()}
        assert got == {(b, s): v for b, of in books.items() for s, v in scored(of, cs or []).items()}


def test_repeated_sample_against_loop(spark):
    import random

    from quillspark.operators import media

    rng = random.Random(2)
    clips = {i: sorted((rng.choice([2.0, 3.5, 9.9, 0.25]) for _ in range(rng.randint(1, 25))), reverse=True) for i in range(80)}
    df = spark.createDataFrame([(i, k + 1, x) for i, xs in clips.items() for k, x in enumerate(xs)], "conv_id int, rank int, duration_s double")
    for r in media.repeated_sample(df).collect():
        total = sum(x + 0.2 for x in clips[r.conv_id])
        n = len(clips[r.conv_id])
        while total < 60:
            for x in clips[r.conv_id]:
                if total >= 60:
                    break
                total += x + 0.3
                n += 1
        assert r.clips == n and math.isclose(r.total_s, total, rel_tol=1e-9)


def test_repeated_sample_at_the_target(spark):
    """Totals that should be 60 s and are a bit less get one clip more, as when clips are added one after the other."""
    from quillspark.operators import media

    clips = {i: [2.0 + 0.08 * ((i * 7 + k) % 40) for k in range(i % 9 + 1)] for i in range(9)} | {10: [7.5200000000000005, 6.32, 5.36], 11: [7.5200000000000005, 3.92], 12: [6.24, 5.2]}
    df = spark.createDataFrame([(i, k + 1, x) for i, xs in clips.items() for k, x in enumerate(xs)], "conv_id int, rank int, duration_s double")
    want = {}
    for i, xs in clips.items():
        t, n = 0.0, len(xs)
        for x in xs:
            t += x + 0.2
        while t < 60:
            t, n = t + xs[n % len(xs)] + 0.3, n + 1
        want[i] = (n, t)
    assert {r.conv_id: (r.clips, r.total_s) for r in media.repeated_sample(df).collect()} == want


def test_lines_profiles(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import lines

    rows = ["THE GREAT ESCAPE STORY", "Growing Up", "XIV", "the quick brown fox jumps", "chapter 3", "Chapter 3", "a story", "Some Story", "12 of 30", "ISBN 1", "isbn 1", "Ab1"]
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    kept = lambda cs: {r.s for r in df.where(~lines.is_marginalia(F.col("s"), cs)).collect()}
    assert kept(True) == {"the quick brown fox jumps", "Chapter 3", "a story", "isbn 1"}
    assert kept(False) == {"a story"}


def test_page_lookup_repeats_and_lists(spark):
    from quillspark.operators import toc
    from quillspark.plans import render

    labels = [("b", "I", 0, 0), ("b", "ii", 1, 1), ("b", "1", 4, 2), ("b", "2", 5, 3), ("b", "5", 9, 4), ("b", "2", 11, 5), ("b", "i", 12, 6), ("c", "10", 2, 0), ("c", "3", 8, 1)]
    df = spark.createDataFrame(labels, "source string, label string, page_idx int, ord int")
    asked = [("b", "2", 5), ("b", "3", 9), ("b", "9", None), ("b", "II", 1), ("b", "i", 0), ("c", "2", 2), ("c", "4", 2), ("c", "11", None)]
    got = {(r.source, r.query): r.page_idx for r in toc.look_up_pages(df, spark.createDataFrame([a[:2] for a in asked], "source string, query string")).collect()}
    assert got == {a[:2]: a[2] for a in asked}


def test_fuzzy_names_against_a_loop(spark):
    import random

    from quillspark.plans import render

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abAé ") for _ in range(rng.randint(0, n)))
    cases = [
        (["Anna", "ann", "Bo", "Carl Otto", "otto", "Zed voice", None], ["ANN", "carl otto jr", "o", "zed", "nobody", "", "x", None]),
        (["abcd", ""], ["q", ""]), ([], ["a", ""]), ([None], ["a"]), ([word(9) for _ in range(60)] + [None], [word(12) for _ in range(150)] + [None, "zzz"]),
        ([word(9) or "a" for _ in range(40)], [word(5) for _ in range(60)] + ["voice of " + word(6) for _ in range(40)]),
    ]
    for names, asked in cases:
        catalog = spark.createDataFrame([(100 - i, n) for i, n in enumerate(names)], "ord int, name string")
        q = spark.createDataFrame([(x,) for x in dict.fromkeys(asked)], "query string")
        order = [n for n in reversed(names) if n is not None]
        for exact in (False, True):
            def first(x):
                same = [n for n in order if n.lower() == x.lower()] if exact else []
                return next(iter(same + [n for n in order if n.lower() in x.lower() or x.lower() in n.lower()]), None)

            got = {r.query: r["name"] for r in render.fuzzy_voice(q, catalog, exact).collect()}
            assert got == {x: None if x is None else first(x) for x in dict.fromkeys(asked)}


def test_contents_without_repeats_against_a_loop(spark):
    import random

    from quillspark.operators import toc

    rng = random.Random(11)
    titles = ["1 Intro", "1 intro ", "1. Start", "2.9 A", "2.9", "2 B", "Notes", "notes", " NOTES", "", "33. X", "33 Y", None, "1.10 Q", "1.1 Q"]
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(titles), rng.randint(0, 25), f"p{i}") for i in rng.sample(range(900), 300)]
    out = {tuple(r[c] for c in ("source", "ord", "title", "page_idx", "printed")) for r in toc.deduplicate(spark.createDataFrame(rows, "source string, ord int, title string, page_idx int, printed string").repartition(4)).collect()}
    want = set()
    for s in ("a", "b", None):
        seen, numbers, kept = set(), set(), []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            t = r[2].strip() if r[2] is not None else None
            m = re.match(r"^\s*(\d+(?:\.\d+)?)", t or "")
            if (t.lower() if t is not None else None) in seen or (m and m.group(1) in numbers):
                continue
            kept.append(r)
            seen.add(t.lower() if t is not None else None)
            numbers |= {m.group(1)} if m else set()
        pages = {}
        for r in kept:
            pages.setdefault(r[3], r)
        want |= set(pages.values())
    assert out == want and len(want) > 20


def plain_paragraphs(text):
    """Paragraphs by a loop over the lines that keeps the paragraph so far."""
    openers = ("Chapter ", "Section ", "Part ", "• ", "* ", "- ", '"')
    connectives = set("and or but yet so for nor because since although though while whereas that which who whom whose where when why how to from with without under over through during he she it they we you i".split())

    def goes_on(par, line):
        words = line.split()
        if len(words) <= 3 and line[0].isupper():
            return False
        if par.count('"') % 2 or par.count("(") > par.count(")") or (len(words) > 1 and words[0].lower() in connectives):
            return True
        opens = line.startswith(openers) or re.match(r"\d+\.\s|[A-Z][a-z]+,|In \d{4}", line) or line.isupper() or (line[0].isupper() and len(words) > 8)
        return bool((par[-1] not in ".!?:;" or par.count("'") % 2 or line[0].islower()) and not opens)

    out, par = [], ""
    for line in [x.strip() for x in (text or "").split("\n")] + [""]:
        if line and par and goes_on(par, line):
            par = " ".join(f"{par} {line}".split())
        else:
            out += [par] if par else []
            out += [""] if not line else []
            par = line
    final, k = [], 0
    while k < len(out):
        n = next((j for j in range(k + 1, len(out)) if out[j]), None) if out[k] else None
        both = n is not None and out[k][-1] not in ".!?" and out[n][0].islower() and not out[n].startswith(("chapter", "section", "part"))
        final.append(f"{out[k]} {out[n]}" if both else out[k])
        k = n + 1 if both else k + 1
    return re.sub(" {2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(final))).strip()


@pytest.mark.parametrize("name", ["q_chapter_pages", "q_chapter_files", "q_page_lookup", "q_contents_scan"])
def test_pages_are_numbered_without_their_texts(spark, monkeypatch, name):
    """Places need no texts, so none is sorted or exchanged for them."""
    from quillspark import queries

    seen, number = [], queries.numbered
    monkeypatch.setattr(queries, "numbered", lambda rows, *a, **k: seen.append(rows.columns) or number(rows, *a, **k))
    queries.QUERIES[name](spark, SF)
    assert seen and not any("text" in c for c in seen)


def test_paragraphs_against_a_loop(spark):
    """Random lines, more than a block of the fold, and whole documents."""
    import random

    from quillspark.operators.paragraphs import rebuild_paragraphs

    rng = random.Random(12)
    bits = ["", "", "  ", "the road", "He said (as ever", "far off)", '"Go', 'on" she said.', "It's late", "don't stop", "Chapter 2", "THE END", "and so on", "I went.", "Anna, who knew", "In 1990 it rained", "It was a very long way down to the old mill.", "ends; ", "3. list", "- item", "part of it", "chapter notes", "x  y", "Él fue", "élan", "(a) b", "why", "One two three"]
    texts = ["\n".join(rng.choice(bits) for _ in range(n)) for n in [*rng.choices(range(1, 14), k=400), 700, 1500]]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string").repartition(4)
    got = {r.doc_id: r.text for r in rebuild_paragraphs(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_paragraphs(t), t


def test_paragraph_rules(spark):
    """One case for each rule that joins lines or keeps them apart."""
    from quillspark.operators.paragraphs import rebuild_paragraphs

    cases = {
        "The road went\non and on.": "The road went on and on.",  # unterminated
        "It ended here.\nNobody came to see it.": "It ended here.\nNobody came to see it.",  # terminated
        'She said "come\nOver here now, all of you" twice.': 'She said "come Over here now, all of you" twice.',  # open quote
        "It was (as they\nSay in towns) late.": "It was (as they Say in towns) late.",  # open parenthesis
        "He stopped.\nand went on alone.": "He stopped. and went on alone.",  # connective
        "They ran.\nPart two": "They ran.\nPart two",  # short line with a capital
        "A long day,\nChapter 5 begins with a storm at sea": "A long day,\nChapter 5 begins with a storm at sea",  # opener
        "  one   two \n\n\n\nThree four five six.": "one two\n\nThree four five six.",
        "no end\n\nlower next": "no end lower next",  # the second pass joins over a blank line
        "": "", "\n\n": "",
    }
    df = spark.createDataFrame([(k, k) for k in cases], "doc_id string, text string")
    assert {r.doc_id: r.text for r in rebuild_paragraphs(df).collect()} == cases
    assert {k: plain_paragraphs(k) for k in cases} == cases


def test_reports_and_catalogs(spark):
    from pyspark.sql import functions as F

    from quillspark.functions.text import footer_label, snippet
    from quillspark.operators import media, toc
    from quillspark.plans import reports

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(one(media.chapter_of_file(F.lit("Chapter_07_the_road"), F.lit(3)))) == ("07", "Chapter 07: The Road")
    assert tuple(one(media.chapter_of_file(F.lit("intro"), F.lit(3)))) == ("3", "Chapter 3")
    assert one(reports.voice_notes(F.lit("Ana"), F.lit(3), F.lit(9.5), F.lit(0.3), F.lit(None).cast("string"))).splitlines()[0] == "# Voice Model: Ana"
    marks = spark.createDataFrame([("b", 0, 1, " Intro ", 1)], "source string, ord int, level int, title string, page int")
    assert tuple(toc.bookmark_entries(marks).first()) == ("b", 0, "Intro", 0)
    assert one(snippet(F.lit("x" * 201))) == "x" * 200 + "..." and one(footer_label(F.array(F.lit("text"), F.lit("Page 12")))) == "12"
    none = spark.createDataFrame([], "source string, ord int, title string, page_idx int, section string")
    books = spark.createDataFrame([("b", "T", "A", "English", "", 0)], "source string, title string, author string, language string, breakdown string, images int")
    assert reports.contents_report(none, books).first().report.endswith("Table of Contents:\n")


def test_spoken_fixed_rows(spark):
    """Each rule by a sentence of its own, worked out by hand."""
    from quillspark.functions import text as T
    from pyspark.sql import functions as F

    rows = {
        "5 A.M. now": "5 A M. now", "at 9 pm": "at 9 pm", "at 9 PM": "at 9 P M", "the U.S.A. today": "the U S A. today", "a u.k. b": "a U K. b", "FBI and CIA": "F B I and C I A", "N.A.S.A": "N A S A",
        "a PhD": "a P H D", "an M.D. and": "an M D. and", "Ma said": "M A said", "BA": "B A", "Dr. No": "Doctor No", "Mr. and Mrs. X": "Mister and Missus X", "Ms. Y, Prof. Z": "Miss Y, Professor Z",
        "St. Ives, 5th Ave. and Old Rd. 3": "Saint Ives, 5th Avenue and Old Road 3", "6 ft": "6 feet", "3 lbs or 1 lb": "3 pounds or 1 pounds", "80kg": "80 kilograms", "60 mph": "60 miles per hour", "9 km/h": "9 kilometers per hour",
        "1990 in Paris": "nineteen 90 inches Paris", "in 2005": "in twenty 05", "1899": "1899", "12,345": "12 thousand 345", "1,234,567": "1 thousand 234,567", "M. Frank": "M Frank", "b. Cole": "b. Cole", " a \n b ": "a b", "": "", None: None,
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.s for r in df.select("t", T.spoken(F.col("t")).alias("s")).collect()} == rows
    plain = spark.createDataFrame([("Ma said",)], "t string")
    assert plain.select(T.spoken(F.col("t"), degrees=False)).first()[0] == "Ma said"


def test_names_and_classes(spark):
    from quillspark.functions import text as T
    from quillspark.operators import media, speakers
    from pyspark.sql import functions as F

    rows = ["o'neil-smith jr", "THE 2nd way", "x", "", "a1b c_d", "élan vital", None]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [r.s for r in df.select(T.title_case(F.col("t")).alias("s")).collect()] == [x.title() if x is not None else None for x in rows]
    assert spark.range(1).select(media.clean_voice_name(F.lit("cloned_anna_o'neil-roe"))).first()[0] == "Anna O'Neil-Roe"
    classes = [("a", ["son"]), ("b", ["john"])]
    names = spark.createDataFrame([("Johnson",), ("John",), ("Mia",)], "t string")
    assert [r.c for r in names.select(T.keyword_class(F.col("t"), classes).alias("c")).collect()] == ["a", "b", "neutral"]
    s = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "doc_id int, speaker string")
    v = spark.createDataFrame([(1, "A", "v1")], "doc_id int, speaker string, voice_id string")
    assert {tuple(r) for r in speakers.voices_or_default(s, v, "d").collect()} == {(1, "A", "v1"), (1, "B", "d"), (2, "A", "d")}


def test_timelines_against_a_loop(spark):
    """Silence and speech laid down one after the other."""
    import random

    from quillspark.plans import render

    rng = random.Random(1)
    chunks = {i: ["w" * rng.choice([3, 9, 10, 40, 200]) for _ in range(rng.randint(1, 9))] for i in range(30)}
    df = spark.createDataFrame([(i, k, c) for i, cs in chunks.items() for k, c in enumerate(cs)], "doc_id int, chunk_no int, chunk string").repartition(3)
    gaps = {"basic": (500, 0, 500, 500), "flowing": (300, 0, 200, 300), "direct": (500, 0, 300, 300), "enhanced": (300, 400, 0, 0), "preview": (100, 0, 100, 100)}
    for name, (lead, before, after, last) in gaps.items():
        want = {}
        for i, cs in chunks.items():
            at, rows = lead, []
            for k, c in enumerate(cs):
                if name == "enhanced" and len(c) < 10:
                    continue
                at += before if k else 0
                est = int(max(1.0, len(c) * 0.08) * 1000)
                rows.append((k, at, at + est))
                at += est + (last if k == len(cs) - 1 else after)
            want |= {(i, k): (a, b, at) for k, a, b in rows}
        got = {(r.doc_id, r.chunk_no): (r.start_ms, r.end_ms, r.total_ms) for r in render.timeline(df, name).collect()}
        assert got == want, name


def test_timelines_read_texts_once(spark):
    """All profiles come of one reading, packing and exchange, with what each gives by itself."""
    from quillspark import queries
    from quillspark.plans import render

    plan = queries.QUERIES["q_timelines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    df = spark.createDataFrame([(i, k, "w" * (i * 5 + k * 3)) for i in range(4) for k in range(i + 1)], "doc_id int, chunk_no int, chunk string")
    names = list(render.PROFILES)
    every = {(r.profile, r.doc_id, r.chunk_no, r.start_ms, r.end_ms, r.total_ms) for r in render.timelines(df, names).collect()}
    assert every == {(p, r.doc_id, r.chunk_no, r.start_ms, r.end_ms, r.total_ms) for p in names for r in render.timeline(df, p).collect()}


def test_edges_as_in_the_reference(spark):
    """A paragraph of the greatest length stays whole; a middle chunk's first letter gets Python's capital."""
    from pyspark.sql import functions as F

    from quillspark.functions import text as T
    from quillspark.operators import chunking

    texts = ["a" * 24 + ".\n" + "b" * n for n in (22, 23, 24, 25)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.pack_paragraphs(F.col("t"), 50, 10).alias("c"))
    assert {r.t: r.c for r in df.collect()} == {t: plain_v5(t, 50, 10) for t in texts} and plain_v5(texts[2], 50, 10) == [texts[2]]
    assert spark.range(1).select(T.middle_capitals(F.array(F.lit("a"), F.lit("ßen"), F.lit("c"))).alias("x")).first().x == ["a", "ßen"[0].upper() + "en", "c"]
